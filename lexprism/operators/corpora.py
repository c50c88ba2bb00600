"""Audits and evidence profiles of many corpora in one job.

Every measure of the audit is a histogram: how many rows of a corpus have a
value. Histograms are counted map-side by corpus and value, so a corpus that
holds most rows is split over all tasks, and quantiles are read off the running
sums of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import require_columns
from ..functions import text as T
from ..session import materialise
from .audit import LENGTH_POINTS, MISSING, availability_counts, document_profile
from .decision import evidence_profile

SUMMARY_POINTS = {"median_words": "median", "p10_words": "p10", "p90_words": "p90"}


def corpus_label(column: Column | str) -> Column:
    """A corpus is named by its trimmed value; rows without one are a corpus of their own."""
    trimmed = T.trimmed((F.col(f"`{column}`") if isinstance(column, str) else column).cast("string"))
    return F.when(trimmed.isNull() | (trimmed == ""), MISSING).otherwise(trimmed)


def corpus_profile(df: DataFrame, text_column: str, corpus: str, unit: str | None = None, group: str | None = None) -> DataFrame:
    """The audit's narrow row for every source row, with the name of its corpus. The text is read once."""
    require_columns(df, corpus=corpus)
    return document_profile(df, text_column, unit, group, corpus_label(corpus))


def length_points(profile: DataFrame, measures: tuple[str, ...] = ("words", "characters")) -> DataFrame:
    """``corpus, measure, point, length``: linear quantiles of every corpus, exact.

    The value at place p of n rows in order is the first whose running count
    passes p; a point between two places is weighted from both.
    """
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("size")) for m in measures]))
    by_size = profile.where("filled").select("corpus", cells).groupBy("corpus", "measure", "size").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("corpus", "measure")
    upto = F.sum("n").over(whole.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = by_size.select("corpus", "measure", "size", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(whole).alias("rows"))

    found = []
    for share in LENGTH_POINTS.values():
        place = F.lit(share) * (F.col("rows") - 1)

        def at(number: Column) -> Column:
            return F.max(F.when((F.col("before") <= number) & (number < F.col("upto")), F.col("size")))

        found.append(F.struct(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part")))
    read = placed.groupBy("corpus", "measure").agg(*[f.alias(name) for f, name in zip(found, LENGTH_POINTS)])
    points = F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("point"), F.col(n).alias("at")) for i, n in enumerate(LENGTH_POINTS)]))
    length = F.col("at.low") + (F.col("at.high") - F.col("at.low")) * F.col("at.part")
    return read.select("corpus", "measure", points).select("corpus", "measure", "position", "point", length.cast("double").alias("length"))


def length_distributions(profile: DataFrame) -> DataFrame:
    """``corpus, point, words, characters``: the audit's length table of every corpus."""
    wide = length_points(profile).groupBy("corpus", "position", "point").pivot("measure", ["words", "characters"]).agg(F.max("length"))
    return wide.orderBy("corpus", "position").select("corpus", "point", F.bround("words", 1).alias("words"), F.bround("characters", 1).alias("characters"))


def group_distributions(profile: DataFrame) -> DataFrame:
    """``corpus, group, source_rows, nonblank_documents, share_nonblank`` of every corpus."""
    per_level = profile.groupBy("corpus", "group").agg(F.count("*").alias("source_rows"), F.count_if("filled").alias("nonblank_documents"))
    everywhere = F.sum("nonblank_documents").over(Window.partitionBy("corpus"))
    return per_level.withColumn("share_nonblank", F.col("nonblank_documents") / F.greatest(everywhere, F.lit(1))).orderBy("corpus", "group")


def corpus_summaries(profile: DataFrame, has_unit: bool) -> DataFrame:
    """``corpus`` and the eighteen audit fields, one row for each corpus.

    Texts, identifiers and levels are counted in one aggregation by (corpus,
    measure, value); its groups are folded to a few numbers before corpora meet.
    """
    flags = profile.groupBy("corpus").agg(*availability_counts())
    level = F.when(F.col("group").isNotNull(), F.struct(F.lit("group").alias("measure"), F.col("group").cast("binary").alias("mark")))
    text = F.when(F.col("filled"), F.struct(F.lit("text").alias("measure"), F.col("text_hash").alias("mark")))
    unit = F.struct(F.lit("unit").alias("measure"), F.col("unit").cast("string").cast("binary").alias("mark"))
    blank_unit = F.col("unit").isNull() | (T.trimmed(F.col("unit").cast("string")) == "")
    marks = [text, level, *([unit] if has_unit else [])]
    listed = profile.select("corpus", "filled", (blank_unit if has_unit else F.lit(False)).alias("blank"), F.explode(F.array_compact(F.array(*marks))).alias("m"))
    counted = listed.groupBy("corpus", "m.measure", "m.mark").agg(
        F.count("*").alias("n"), F.count_if("filled").alias("held"), F.first("blank").alias("blank")
    )
    copied = (F.col("measure") == "text") & (F.col("n") > 1)
    named = (F.col("measure") == "group") & (F.col("mark") != F.lit(MISSING).cast("binary"))
    unnamed = (F.col("measure") == "group") & (F.col("mark") == F.lit(MISSING).cast("binary"))
    a_unit = F.col("measure") == "unit"

    def added(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    folded = counted.groupBy("corpus").agg(
        added(copied).alias("exact_duplicate_rows"),
        F.count_if(copied).alias("exact_duplicate_sets"),
        added(a_unit & ~F.col("blank") & (F.col("n") > 1)).alias("duplicate_unit_rows"),
        added(a_unit & F.col("blank")).alias("missing_unit_rows"),
        F.count_if(named).alias("group_levels"),
        F.coalesce(F.min(F.when(named, F.col("held"))), F.lit(0)).alias("minimum_group_documents"),
        added(unnamed).alias("missing_group_rows"),
    )
    word = F.col("measure") == "words"
    lengths = length_points(profile, ("words",)).where(word).groupBy("corpus").agg(
        *[F.max(F.when(F.col("point") == point, F.col("length"))).alias(name) for name, point in SUMMARY_POINTS.items()]
    )
    joined = flags.join(folded, "corpus", "left").join(lengths, "corpus", "left")
    counts = ["exact_duplicate_rows", "exact_duplicate_sets", "duplicate_unit_rows", "missing_unit_rows"]
    groups = ["group_levels", "minimum_group_documents", "missing_group_rows"]
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in counts + groups}  # a corpus of blank texts only
    return joined.withColumns(zero).select(
        "corpus", "source_rows", "analyzable_documents", "blank_documents", "blank_rate", *counts, *SUMMARY_POINTS,
        "documents_below_five_words", "documents_with_possible_email", "documents_with_possible_phone", "documents_with_url", *groups,
    )


def lexical_facts(matrix: DataFrame) -> DataFrame:
    """``corpus, vocabulary_size, lexical_coverage`` of a shared vocabulary's matrix whose labels are corpora.

    The size counts the terms that occur in the corpus; each document sends only
    its term numbers, and equal ones combine within a task.
    """
    terms = matrix.select("label", F.explode("indices").alias("term_id")).groupBy("label", "term_id").agg(F.lit(1).alias("one"))
    size = terms.groupBy("label").agg(F.count("*").alias("vocabulary_size"))
    covered = matrix.groupBy("label").agg(F.avg((F.size("indices") > 0).cast("double")).alias("lexical_coverage"))
    joined = covered.join(size, "label", "left")
    return joined.select(
        corpus_label("label").alias("corpus"), F.coalesce("vocabulary_size", F.lit(0)).alias("vocabulary_size"), "lexical_coverage"
    )


def topic_facts(shares: DataFrame, topics: int, threshold: float) -> DataFrame:
    """``corpus, minimum_topic_prevalence, ambiguous_document_rate`` of documents (label, shares) of shared topics.

    The prevalence of a topic is its mean share within the corpus.
    """
    means = [F.avg(F.get("shares", F.lit(k))) for k in range(topics)]
    unclear = F.avg((F.array_max("shares") < threshold).cast("double"))
    smallest = F.least(*means) if topics > 1 else means[0]
    return shares.groupBy(corpus_label("label").alias("corpus")).agg(
        smallest.alias("minimum_topic_prevalence"), unclear.alias("ambiguous_document_rate")
    )


def corpus_evidence(
    summaries: DataFrame, lexical: DataFrame, topical: DataFrame, planned_topics: int, minimum_topic_stability: Column | float
) -> DataFrame:
    """``corpus, status, meaning, action``: the next step of each corpus, from what was measured on it.

    Topics are those of one joint model, whose weakest stability holds for all.
    A corpus without usable documents has no lexical facts and is limited.
    """
    weakest = minimum_topic_stability if isinstance(minimum_topic_stability, Column) else F.lit(float(minimum_topic_stability))
    facts = summaries.join(lexical, "corpus", "left").join(topical, "corpus", "left").select(
        "*", F.lit(planned_topics).alias("planned_topics"), weakest.alias("minimum_topic_stability")
    )
    filled = facts.withColumns({
        "vocabulary_size": F.coalesce("vocabulary_size", F.lit(0)), "lexical_coverage": F.coalesce("lexical_coverage", F.lit(0.0)),
        "median_words": F.coalesce("median_words", F.lit(0.0)), "minimum_topic_prevalence": F.coalesce("minimum_topic_prevalence", F.lit(0.0)),
        "ambiguous_document_rate": F.coalesce("ambiguous_document_rate", F.lit(0.0)),
    })
    return evidence_profile(filled, "corpus")


def audit_corpora(df: DataFrame, text_column: str, corpus: str, unit: str | None = None, group: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, length tables and group tables of every corpus of ``df``, from one read of its texts."""
    profile = materialise(corpus_profile(df, text_column, corpus, unit, group), "corpora")
    groups = group_distributions(profile)
    return corpus_summaries(profile, unit is not None), length_distributions(profile), groups if group else groups.where(F.lit(False))
