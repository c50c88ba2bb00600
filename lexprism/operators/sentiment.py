"""Rule-based lexicon scores per document and their aggregates.

A document is scored in its own row, so scoring moves no row between tasks
whatever the length or number of documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import period_label, t_quantile
from ..functions.times import mixed_time
from .audit import MISSING
from .lexicon import (
    IN_TASK_LEXICON_LIMIT,
    NEGATING,
    PHRASE_BOOSTS,
    PHRASES,
    STRENGTHENING,
    WEAKENING,
    joined_valences,
    listed_words,
)
from .scoring import PUNCTUATION, Rules, score_sums

SCORE_UNITS = 10_000  # compound scores have four decimals


@dataclass(frozen=True)
class ScoreRules:
    """Fixed values of the published scoring rule (Hutto & Gilbert 2014); word lists can be replaced."""

    booster: float = 0.293
    capitals: float = 0.733
    negation: float = -0.74
    never_so: float = 1.25
    distance_scale: tuple[float, float, float] = (1.0, 0.95, 0.90)
    before_but: float = 0.5
    after_but: float = 1.5
    exclamation: float = 0.292
    exclamation_cap: int = 4
    question: float = 0.18
    question_cap: float = 0.96
    normalising: float = 15.0
    threshold: float = 0.05
    strengthening: tuple[str, ...] = STRENGTHENING
    weakening: tuple[str, ...] = WEAKENING
    negating: tuple[str, ...] = NEGATING
    contrast: str = "but"
    phrases: tuple[tuple[str, float], ...] = PHRASES
    phrase_boosts: tuple[tuple[str, float], ...] = PHRASE_BOOSTS


RULES = ScoreRules()


def with_words(documents: DataFrame) -> DataFrame:
    """Split on blanks; strip punctuation from both ends unless under three characters stay."""

    def kept(token: Column, bare: Column) -> Column:
        return F.when(F.char_length(bare) <= 2, token).otherwise(bare)

    split = documents.withColumn("_split", F.split("norm_text", " "))
    bare = F.transform("_split", lambda token: F.btrim(token, F.lit(PUNCTUATION)))
    cased = split.withColumn("cased", F.zip_with("_split", bare, kept)).drop("_split")
    return cased.withColumn("words", F.transform("cased", F.lower))


def predicted_label(compound: Column, binary: bool) -> Column:
    if binary:
        return F.when(compound >= 0, "positive").otherwise("negative")
    t = RULES.threshold
    return F.when(compound >= t, "positive").when(compound <= -t, "negative").otherwise("neutral")


def _summed(rules: ScoreRules, words: Sequence[str], valences: Sequence[float], looked_up: bool):
    """The scoring kernel as a column function of the text, and of its words' valences where these were joined."""
    ready = Rules(rules, words, valences)

    def in_task(texts: pa.Array) -> pa.Array:
        return score_sums(texts, None, ready)

    def joined(texts: pa.Array, found: pa.Array) -> pa.Array:
        return score_sums(texts, found, ready)

    kernel = joined if looked_up else in_task
    arguments = ("texts", "found") if looked_up else ("texts",)
    kernel.__annotations__ = {name: pa.Array for name in (*arguments, "return")}
    return F.arrow_udf(kernel, "raw double, up double, down double, flat double, emphasis double")


def document_scores(
    documents: DataFrame,
    lexicon: DataFrame,
    rules: ScoreRules = RULES,
    in_task_limit: int = IN_TASK_LEXICON_LIMIT,
) -> DataFrame:
    """Proportions, compound score and label per row of ``documents`` (needs ``norm_text``).

    Each text is visited once, in its own row. A lexicon of up to
    ``in_task_limit`` words travels with the tasks; the words of a larger one
    are joined first.
    """
    keep = [c for c in documents.columns if c != "norm_text"]
    words, valences = listed_words(lexicon, in_task_limit)
    if words is None:
        found = joined_valences(with_words(documents), lexicon)
        kernel = _summed(rules, (), (), True)(F.col("norm_text"), F.col("valences"))
    else:
        found = documents
        kernel = _summed(rules, words, valences, False)(F.col("norm_text"))
    sums = found.select(*keep, kernel.alias("_sums")).select(*keep, "_sums.*")
    pushed = sums.withColumn("raw", F.col("raw") + F.signum("raw") * F.col("emphasis"))
    up = F.when(F.col("up") > F.col("down"), F.col("up") + F.col("emphasis")).otherwise(F.col("up"))
    down = F.when(F.col("down") > F.col("up"), F.col("down") + F.col("emphasis")).otherwise(F.col("down"))
    shares = pushed.select(*keep, "raw", "flat", up.alias("up"), down.alias("down")).withColumn(
        "everything", F.col("up") + F.col("down") + F.col("flat")
    )
    squeezed = F.col("raw") / F.sqrt(F.col("raw") * F.col("raw") + rules.normalising)
    scored = shares.select(
        *keep,
        F.round(F.col("down") / F.col("everything"), 3).alias("negative"),
        F.round(F.col("flat") / F.col("everything"), 3).alias("neutral"),
        F.round(F.col("up") / F.col("everything"), 3).alias("positive"),
        F.round(squeezed, 4).alias("compound"),
    )
    return scored.withColumn("lexicon_label", predicted_label(F.col("compound"), binary=False))


def score_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Count, mean, median, 95 % t interval and polarity shares, per ``by``.

    Compound scores have four decimals, so they are first counted by value:
    the shuffle holds at most 20,001 rows per group and task however many
    documents share a group. Sums are whole numbers of ten-thousandths, so the
    mean and the spread are the same however the rows are spread.
    """
    value = F.col("compound").cast("double")
    per_value = scores.select(*by, value.alias("v")).filter("v is not null and not isnan(v)").groupBy(*by, "v")
    counted = per_value.agg(F.count("*").alias("n")).withColumn("units", F.round(F.col("v") * SCORE_UNITS).cast("long"))
    n = F.sum("n")
    t = RULES.threshold
    sums = counted.groupBy(*by).agg(
        n.alias("documents"),
        F.sum(F.col("units") * F.col("n")).alias("_sum"),
        F.percentile("v", F.lit(0.5), F.col("n")).alias("median_compound"),
        F.sum((F.col("units") * F.col("units")).cast("decimal(10,0)") * F.col("n").cast("decimal(18,0)")).alias("_squares"),
        (F.sum(F.when(F.col("v") >= t, F.col("n")).otherwise(0)) / n).alias("positive_share"),
        (F.sum(F.when(F.col("v") <= -t, F.col("n")).otherwise(0)) / n).alias("negative_share"),
        (F.sum(F.when((F.col("v") > -t) & (F.col("v") < t), F.col("n")).otherwise(0)) / n).alias("neutral_share"),
    )
    docs, whole = F.col("documents"), F.col("_sum").cast("decimal(18,0)")
    mean = F.col("_sum") / (docs * SCORE_UNITS)
    # documents times the sum of squared deviations, exact
    centred = (F.col("_squares").cast("decimal(22,0)") * docs.cast("decimal(15,0)") - whole * whole).cast("double")
    reach = t_quantile(docs - 1) * F.sqrt(centred / docs / (docs - 1) / docs) / SCORE_UNITS
    many = docs > 1
    return sums.select(
        *by,
        "documents",
        mean.alias("mean_compound"),
        "median_compound",
        F.when(many, mean - reach).alias("ci_low"),
        F.when(many, mean + reach).alias("ci_high"),
        "positive_share",
        "negative_share",
        "neutral_share",
    )


def overall_summary(scores: DataFrame) -> DataFrame:
    summary = score_summary(scores)
    return summary.select(F.lit("all usable documents").alias("scope"), *summary.columns)


def parsed_time(column: str, formats: Sequence[str] = (), days_first: frozenset[str] | None = None) -> Column:
    """A time in the standard form or in the first of ``formats`` that fits; null for any other text.

    With ``days_first`` (see ``functions.times``) the usual mixed forms are read too.
    """
    text = F.col(column).cast("string")
    mixed = [] if days_first is None else [mixed_time(text, days_first)]
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(form)) for form in formats], *mixed)


def time_parse_rate(
    scores: DataFrame, time_column: str, formats: Sequence[str] = (), days_first: frozenset[str] | None = None
) -> DataFrame:
    """One row: share of scored documents whose declared time can be read."""
    return scores.agg(F.avg(parsed_time(time_column, formats, days_first).isNotNull().cast("double")).alias("parse_rate"))


def time_summary(
    scores: DataFrame, time_column: str, grain: str, formats: Sequence[str] = (), days_first: frozenset[str] | None = None
) -> DataFrame:
    """Score summary of each calendar period, in the session's time zone."""
    timed = scores.withColumn("period", period_label(parsed_time(time_column, formats, days_first), grain))
    return score_summary(timed.filter(F.col("period").isNotNull()), "period").orderBy("period")


def dimension_summary(scores: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Every declared dimension by itself, in one pass; '' stays a level of its own."""

    def level(name: str) -> Column:
        return T.trimmed(F.coalesce(F.col(name).cast("string"), F.lit(MISSING)))

    listed = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("position"), F.lit(name).alias("dimension"), level(name).alias("level"))
                for i, name in enumerate(dimensions)
            ]
        )
    )
    compared = scores.select("compound", listed)
    return score_summary(compared, "position", "dimension", "level").orderBy("position", "level").drop("position")


def folded_duplicate_rate(folded: DataFrame, hashed: str | None = None) -> DataFrame:
    """One row: share of scored documents whose case-folded text occurs more than once.

    ``hashed`` names a column that already holds the hash of that text.
    """
    copies = folded.groupBy((F.col(hashed) if hashed else F.unhex(F.sha2("folded_text", 256))).alias("h")).agg(F.count("*").alias("n"))
    repeated = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return copies.agg((repeated / F.sum("n")).alias("duplicate_rate"))
