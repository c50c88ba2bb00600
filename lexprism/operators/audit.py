"""Corpus audit: availability, lengths, duplicates, groups and contact patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DataProblem, require_columns
from ..functions import text as T
from ..session import evened, materialise

# The reported points of the length table.
LENGTH_POINTS = {
    "minimum": 0.0,
    "p10": 0.10,
    "p25": 0.25,
    "median": 0.50,
    "p75": 0.75,
    "p90": 0.90,
    "maximum": 1.0,
}
MISSING = "(missing)"
SHORT_DOCUMENT_WORDS = 5


@dataclass(frozen=True)
class CorpusAudit:
    summary: DataFrame
    length_distribution: DataFrame
    group_distribution: DataFrame
    warnings: DataFrame


def document_profile(
    df: DataFrame, text_column: str, unit: str | None = None, group: str | None = None, corpus: Column | None = None
) -> DataFrame:
    """One narrow row per source row; the text itself is left behind here. With ``corpus`` each row names its corpus."""
    require_columns(df, text=text_column, unit=unit, group=group)
    label = F.lit(None).cast("string")
    if group:
        trimmed = T.group_label(group)
        label = F.when(trimmed == "", MISSING).otherwise(trimmed)
    source = evened(
        df.select(
            F.col(text_column).alias("raw_text"),
            (F.col(unit) if unit else F.lit(None).cast("string")).alias("unit"),
            label.alias("group"),
            *([] if corpus is None else [corpus.alias("corpus")]),
        )
    )
    normalised = source.withColumn("norm_text", T.normalized("raw_text"))
    filled = F.col("norm_text") != ""
    return normalised.select(
        *([] if corpus is None else ["corpus"]),
        "unit",
        "group",
        filled.alias("filled"),
        F.when(filled, T.word_count("norm_text")).alias("words"),
        F.when(filled, F.char_length("norm_text")).alias("characters"),
        F.when(filled, F.unhex(F.sha2("norm_text", 256))).alias("text_hash"),
        (filled & T.has_email("norm_text")).alias("email"),
        (filled & T.has_phone("norm_text")).alias("phone"),
        (filled & T.has_url("norm_text")).alias("url"),
    )


def availability_counts() -> list[Column]:
    """Rows, blanks, short documents and contact flags of a profile or of one corpus of it."""
    return [
        F.count("*").alias("source_rows"),
        F.count_if("filled").alias("analyzable_documents"),
        F.count_if(~F.col("filled")).alias("blank_documents"),
        F.try_divide(F.count_if(~F.col("filled")), F.count("*")).alias("blank_rate"),
        F.count_if(F.col("words") < SHORT_DOCUMENT_WORDS).alias("documents_below_five_words"),
        F.count_if("email").alias("documents_with_possible_email"),
        F.count_if("phone").alias("documents_with_possible_phone"),
        F.count_if("url").alias("documents_with_url"),
    ]


def availability(profile: DataFrame) -> DataFrame:
    """One row: the counts over the whole profile."""
    return profile.agg(*availability_counts())


def length_quantiles(profile: DataFrame) -> DataFrame:
    """``measure, at`` with exact linear quantiles in point order.

    Lengths are counted by value first (few distinct values, combined
    map-side), so the exact quantile never sees one entry per document.
    """
    measures = F.inline(
        F.array(
            F.struct(F.lit("words").alias("measure"), F.col("words").alias("size")),
            F.struct(F.lit("characters").alias("measure"), F.col("characters").alias("size")),
        )
    )
    by_size = profile.filter("filled").select(measures).groupBy("measure", "size").agg(F.count("*").alias("n"))
    points = F.array(*[F.lit(p) for p in LENGTH_POINTS.values()])
    return by_size.groupBy("measure").agg(F.percentile("size", points, F.col("n")).alias("at"))


def length_distribution(profile: DataFrame) -> DataFrame:
    """Seven rows: word and character lengths at each point, to one decimal, half to even."""
    names = F.array(*[F.lit(name) for name in LENGTH_POINTS])
    order = F.array(*[F.lit(i) for i in range(len(LENGTH_POINTS))])
    values = length_quantiles(profile).select(
        "measure", F.inline(F.arrays_zip(names.alias("point"), order.alias("position"), F.col("at").alias("length")))
    )
    wide = values.groupBy("position", "point").pivot("measure", ["words", "characters"]).agg(F.max("length"))
    return wide.orderBy("position").select(
        "point", F.bround("words", 1).alias("words"), F.bround("characters", 1).alias("characters")
    )


def exact_duplicates(profile: DataFrame) -> DataFrame:
    """One row: documents in any set of equal normalised texts, and how many sets."""
    copies = profile.filter("filled").groupBy("text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("exact_duplicate_rows"), F.count("*").alias("exact_duplicate_sets")
    )


def unit_checks(profile: DataFrame) -> DataFrame:
    """One row: rows sharing a present identifier, and rows without one.

    Sharing compares the raw identifier; only presence looks at the trimmed one.
    """
    per_value = profile.groupBy("unit").agg(F.count("*").alias("n"))
    blank = F.col("unit").isNull() | (T.trimmed(F.col("unit").cast("string")) == "")
    return per_value.agg(
        F.coalesce(F.sum(F.when(~blank & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_unit_rows"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("missing_unit_rows"),
    )


def group_distribution(profile: DataFrame) -> DataFrame:
    """Rows, non-blank documents and share of all non-blank documents per level."""
    per_level = profile.groupBy("group").agg(
        F.count("*").alias("source_rows"), F.count_if("filled").alias("nonblank_documents")
    )
    everywhere = profile.agg(F.greatest(F.count_if("filled"), F.lit(1))).scalar()
    return per_level.withColumn("share_nonblank", F.col("nonblank_documents") / everywhere).orderBy("group")


def group_summary(profile: DataFrame) -> DataFrame:
    """One row: number of levels, smallest level, rows without a level."""
    per_level = profile.groupBy("group").agg(
        F.count("*").alias("source_rows"), F.count_if("filled").alias("nonblank_documents")
    )
    level = F.col("group") != MISSING
    return per_level.filter(F.col("group").isNotNull()).agg(
        F.count_if(level).alias("group_levels"),
        F.coalesce(F.min(F.when(level, F.col("nonblank_documents"))), F.lit(0)).alias("minimum_group_documents"),
        F.coalesce(F.sum(F.when(~level, F.col("source_rows"))), F.lit(0)).alias("missing_group_rows"),
    )


def audit_summary(profile: DataFrame, has_unit: bool) -> DataFrame:
    """The eighteen-field summary row, assembled from one-row aggregates."""

    def record(one_row: DataFrame):
        return one_row.select(F.struct(*one_row.columns)).scalar()

    quantiles = length_quantiles(profile).filter(F.col("measure") == "words").select("at").scalar()
    units = unit_checks(profile) if has_unit else None
    parts = availability(profile).select(
        "*",
        record(exact_duplicates(profile)).alias("d"),
        record(group_summary(profile)).alias("g"),
        quantiles.alias("q"),
        (record(units) if units is not None else F.struct(
            F.lit(0).cast("long").alias("duplicate_unit_rows"), F.lit(0).cast("long").alias("missing_unit_rows")
        )).alias("u"),
    )
    point = {name: i for i, name in enumerate(LENGTH_POINTS)}
    return parts.select(
        "source_rows",
        "analyzable_documents",
        "blank_documents",
        "blank_rate",
        "d.exact_duplicate_rows",
        "d.exact_duplicate_sets",
        "u.duplicate_unit_rows",
        "u.missing_unit_rows",
        F.get("q", F.lit(point["median"])).alias("median_words"),
        F.get("q", F.lit(point["p10"])).alias("p10_words"),
        F.get("q", F.lit(point["p90"])).alias("p90_words"),
        "documents_below_five_words",
        "documents_with_possible_email",
        "documents_with_possible_phone",
        "documents_with_url",
        "g.group_levels",
        "g.minimum_group_documents",
        "g.missing_group_rows",
    )


def flagged(row: DataFrame, rules: list[tuple]) -> DataFrame:
    """``code, message`` for every rule whose condition holds on a one-row table."""
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(code).alias("code"),
            (message if not isinstance(message, str) else F.lit(message)).alias("message"),
            condition.alias("holds"),
        )
        for i, (code, condition, message) in enumerate(rules)
    ]
    listed = row.select(F.inline(F.array(*entries)))
    return listed.filter("holds").orderBy("position").select("code", "message")


def audit_warnings(summary: DataFrame, has_group: bool) -> DataFrame:
    grouped = F.lit(has_group)
    smallest = F.col("minimum_group_documents")
    return flagged(
        summary,
        [
            (
                "repeated_identifier",
                F.col("duplicate_unit_rows") > 0,
                "Identifiers occur more than once, so the unit of analysis is unclear.",
            ),
            ("many_blanks", F.col("blank_rate") > 0.10, "Over a tenth of the rows hold no text."),
            (
                "exact_duplicates",
                F.col("exact_duplicate_rows") > 0,
                "Some texts are identical; templates or reposts can inflate term counts.",
            ),
            ("short_documents", F.col("median_words") < 8, "Half of the documents have under eight words."),
            (
                "contact_details",
                (F.col("documents_with_possible_email") > 0) | (F.col("documents_with_possible_phone") > 0),
                "Some texts look like they hold an email address or a phone number.",
            ),
            ("few_levels", grouped & (F.col("group_levels") < 2), "The comparison column has no two levels."),
            (
                "small_level",
                grouped & (smallest > 0) & (smallest < 30),
                "A comparison level has under thirty non-blank documents.",
            ),
        ],
    )


def audit_corpus(
    df: DataFrame,
    text_column: str,
    unit: str | None = None,
    group: str | None = None,
    max_rows: int | None = None,
) -> CorpusAudit:
    """Audit a corpus. The text is read once; every table comes from its narrow profile."""
    profile = materialise(document_profile(df, text_column, unit, group), "profile")
    size = profile.agg(F.count("*").alias("rows"), F.count_if("filled").alias("filled")).first()
    if not size["rows"]:
        raise DataProblem("The table has no rows.")
    if max_rows is not None and size["rows"] > max_rows:
        raise DataProblem(f"The table has {size['rows']} rows; at most {max_rows} are allowed.")
    if not size["filled"]:
        raise DataProblem(f"Column {text_column!r} holds no non-blank text.")
    summary = audit_summary(profile, unit is not None)
    groups = group_distribution(profile)
    if not group:
        groups = groups.filter(F.lit(False))
    return CorpusAudit(summary, length_distribution(profile), groups, audit_warnings(summary, group is not None))
