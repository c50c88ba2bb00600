"""Group keyness: smoothed log odds with an informative prior."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    CONTRAST_PRIOR_MASS,
    MAX_GROUP_LEVELS,
    MIN_GROUP_DOCUMENTS,
    SYMMETRIC_TOP_TERMS,
    VARIANT_TOP_TERMS,
    DataProblem,
    TextConfig,
)
from .vocabulary import Vocabulary, matrix_entries

SYMMETRIC = "two-group symmetric"
ONE_VS_REST = "one-vs-rest per variant"
NO_CONTRAST = "none"


@dataclass(frozen=True)
class Comparison:
    design: str
    levels: tuple[str, ...]


def level_support(documents: DataFrame) -> DataFrame:
    """``level, documents, supported`` per non-blank comparison label."""
    return (
        documents.filter(F.col("label") != "")
        .groupBy(F.col("label").alias("level"))
        .agg(F.count("*").alias("documents"))
        .withColumn("supported", F.col("documents") >= MIN_GROUP_DOCUMENTS)
    )


def choose_comparison(documents: DataFrame, config: TextConfig) -> Comparison:
    """Pick the contrast design, refusing too many levels or thin groups."""
    if not config.group:
        return Comparison(NO_CONTRAST, ())
    support = level_support(documents)
    found = support.orderBy("level").limit(MAX_GROUP_LEVELS + 1).collect()
    if len(found) > MAX_GROUP_LEVELS:
        raise DataProblem(
            f"Column {config.group!r} has more than {MAX_GROUP_LEVELS} levels; merge related levels first."
        )
    sizes = {row["level"]: row["documents"] for row in found}
    levels = tuple(sizes)
    if config.symmetric:
        return Comparison(SYMMETRIC, levels)
    if len(levels) < 2:
        return Comparison(NO_CONTRAST, levels)
    thin = [level for level in levels if sizes[level] < MIN_GROUP_DOCUMENTS]
    if thin:
        raise DataProblem(
            f"Every compared level needs {MIN_GROUP_DOCUMENTS} non-blank documents; {thin[0]!r} has {sizes[thin[0]]}."
        )
    return Comparison(ONE_VS_REST, levels)


def require_supported_groups(documents: DataFrame, config: TextConfig) -> None:
    """The two groups of a symmetric contrast need enough documents each."""
    wanted = [str(config.focal_group), str(config.reference_group)]
    named = level_support(documents.filter(F.col("label").isin(wanted)))
    sizes = {row["level"]: row["documents"] for row in named.collect()}
    if any(sizes.get(name, 0) < MIN_GROUP_DOCUMENTS for name in wanted):
        raise DataProblem(f"Both contrasted groups need {MIN_GROUP_DOCUMENTS} non-blank documents.")


def log_odds(counts: DataFrame, first: str, second: str, per: str) -> DataFrame:
    """Add ``log_odds`` and ``z_score`` for two count columns.

    Totals run over the whole vocabulary within each value of ``per``; one such
    group holds at most as many rows as the vocabulary has terms.
    """
    whole = Window.partitionBy(per)
    y1, y2 = F.col(first).cast("double"), F.col(second).cast("double")
    with_totals = counts.select(
        "*",
        F.sum(y1).over(whole).alias("_n1"),
        F.sum(y2).over(whole).alias("_n2"),
        F.count("*").over(whole).alias("_terms"),
    )
    prior_mass = F.lit(CONTRAST_PRIOR_MASS)
    with_prior = with_totals.withColumn(
        "_alpha", prior_mass * (y1 + y2 + 1.0) / (F.col("_n1") + F.col("_n2") + F.col("_terms"))
    )

    def log_odd(y: Column, n: str) -> Column:
        mass = y + F.col("_alpha")
        return F.log(mass / (F.col(n) + prior_mass - mass))

    scored = with_prior.withColumn("log_odds", log_odd(y1, "_n1") - log_odd(y2, "_n2"))
    spread = F.sqrt(1.0 / (y1 + F.col("_alpha")) + 1.0 / (y2 + F.col("_alpha")))
    return scored.withColumn("z_score", F.col("log_odds") / spread).drop("_n1", "_n2", "_terms", "_alpha")


def label_term_counts(matrix: DataFrame) -> DataFrame:
    """``label, term_id, n``: combines map-side to labels x vocabulary rows."""
    return matrix_entries(matrix, "label").groupBy("label", "term_id").agg(F.sum("n").alias("n"))


def symmetric_contrast(matrix: DataFrame, vocabulary: Vocabulary, config: TextConfig) -> DataFrame:
    """The largest absolute z scores between two named groups."""
    focal, reference = str(config.focal_group), str(config.reference_group)
    sides = matrix.filter(F.col("label").isin(focal, reference))
    per_term = (
        label_term_counts(sides)
        .groupBy("term_id")
        .agg(
            F.sum(F.when(F.col("label") == focal, F.col("n"))).alias("f"),
            F.sum(F.when(F.col("label") == reference, F.col("n"))).alias("r"),
        )
    )
    counts = (
        vocabulary.table(matrix.sparkSession)
        .join(per_term, "term_id", "left")
        .select(
            "term",
            F.coalesce("f", F.lit(0)).alias("focal_count"),
            F.coalesce("r", F.lit(0)).alias("reference_count"),
            F.lit(f"{focal} vs {reference}").alias("comparison"),
        )
    )
    return (
        log_odds(counts, "focal_count", "reference_count", "comparison")
        .filter(F.col("focal_count") + F.col("reference_count") >= config.min_df)
        .select(
            "term",
            "focal_count",
            "reference_count",
            "log_odds",
            "z_score",
            F.when(F.col("log_odds") >= 0, focal).otherwise(reference).alias("direction"),
        )
        .orderBy(F.desc(F.abs("z_score")), "term")
        .limit(SYMMETRIC_TOP_TERMS)
    )


def variant_contrast(
    matrix: DataFrame, vocabulary: Vocabulary, levels: tuple[str, ...], config: TextConfig
) -> DataFrame:
    """Each level against all other documents, unlabelled ones included."""
    per_label = label_term_counts(matrix)
    totals = per_label.groupBy("term_id").agg(
        F.sum("n").alias("everywhere"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label")
    )
    counts = (
        vocabulary.table(matrix.sparkSession)
        .join(totals, "term_id", "left")
        .select("term", "everywhere", "by_label", F.explode(F.array(*[F.lit(x) for x in levels])).alias("variant"))
        .select(
            "variant",
            "term",
            F.coalesce(F.try_element_at("by_label", F.col("variant")), F.lit(0)).alias("variant_count"),
            F.coalesce("everywhere", F.lit(0)).alias("total"),
        )
        .withColumn("rest_count", F.col("total") - F.col("variant_count"))
    )
    ranked = (
        log_odds(counts, "variant_count", "rest_count", "variant")
        .filter(F.col("total") >= config.min_df)
        .withColumn(
            "rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("z_score"), "term"))
        )
        .filter(F.col("rank") <= VARIANT_TOP_TERMS)
    )
    return ranked.select(
        "variant",
        "term",
        "variant_count",
        "rest_count",
        "log_odds",
        "z_score",
        F.concat("variant", F.lit(" vs rest")).alias("comparison"),
    ).orderBy("variant", F.desc("z_score"), "term")
