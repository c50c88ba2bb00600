"""Agreement of lexicon labels with human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SentimentConfig
from .sentiment import predicted_label

# Limits and names of the validation status.
ENOUGH_LABELS = 100
ENOUGH_AGREEMENT = 0.70
UNVALIDATED = "UNVALIDATED LEXICON SIGNAL"
NO_LABELS = "VALIDATION MISSING"
FEW_LABELS = "VALIDATION LIMITED"
SUPPORTED = "LOCALLY SUPPORTED"
NOT_SUPPORTED = "MODEL DOES NOT TRANSFER"

MEANINGS = {
    UNVALIDATED: "No label column was named, so no agreement was measured.",
    NO_LABELS: "The label column holds none of the values declared as labels.",
    FEW_LABELS: f"Fewer than {ENOUGH_LABELS} documents carry a declared label.",
    SUPPORTED: f"Balanced accuracy and macro F1 both reach {ENOUGH_AGREEMENT:.2f} on the labelled documents.",
    NOT_SUPPORTED: f"Balanced accuracy or macro F1 stays below {ENOUGH_AGREEMENT:.2f} on the labelled documents.",
}


def classes_of(config: SentimentConfig) -> list[str]:
    return ["negative", "positive"] if config.neutral_label is None else ["negative", "neutral", "positive"]


def human_class(config: SentimentConfig) -> Column:
    """The class a human label maps to by exact match; null for any other label."""
    label = F.col(config.human_label_column).cast("string")
    mapped = F.lit(None).cast("string")
    if config.neutral_label:
        mapped = F.when(label == str(config.neutral_label), "neutral").otherwise(mapped)
    mapped = F.when(label == str(config.negative_label), "negative").otherwise(mapped)
    if config.positive_label != config.negative_label:
        mapped = F.when(label == str(config.positive_label), "positive").otherwise(mapped)
    return mapped


def labelled_scores(scores: DataFrame, config: SentimentConfig) -> DataFrame:
    """``truth, predicted`` for the scored documents with a mapped human label."""
    predicted = predicted_label(F.col("compound"), binary=config.neutral_label is None)
    return scores.select(human_class(config).alias("truth"), predicted.alias("predicted")).filter("truth is not null")


def confusion(labelled: DataFrame, classes: list[str]) -> DataFrame:
    """All class pairs in long form, zeros included; empty without labelled documents."""
    counted = labelled.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    pairs = [(i, j, a, b) for i, a in enumerate(classes) for j, b in enumerate(classes)]
    grid = labelled.sparkSession.createDataFrame(pairs, "i int, j int, truth string, predicted string")
    everything = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return (
        F.broadcast(grid)
        .join(counted, ["truth", "predicted"], "left")
        .withColumn("everything", everything)
        .filter("everything > 0")
        .orderBy("i", "j")
        .select(
            F.col("truth").alias("human_label"),
            F.col("predicted").alias("predicted_label"),
            F.coalesce("n", F.lit(0)).alias("documents"),
        )
    )


def confusion_matrix(long_form: DataFrame, classes: list[str]) -> DataFrame:
    """Wide form: one row per human label, one column per predicted label."""
    return long_form.groupBy("human_label").pivot("predicted_label", classes).agg(F.sum("documents")).orderBy("human_label")


def class_metrics(confusion_table: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    sides = confusion_table.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("human_label").alias("class"),
                    F.col("documents").alias("truth"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("human_label") == F.col("predicted_label"), F.col("documents")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("predicted_label").alias("class"),
                    F.lit(0).cast("long").alias("truth"),
                    F.col("documents").alias("predicted"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("truth").alias("truth"), F.sum("predicted").alias("predicted")
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return sums.orderBy("class").select(
        "class",
        share(F.col("hit"), F.col("predicted")).alias("precision"),
        share(F.col("hit"), F.col("truth")).alias("recall"),
        share(2.0 * F.col("hit"), F.col("truth") + F.col("predicted")).alias("f1"),
        F.col("truth").alias("support"),
    )


def validation_summary(metrics: DataFrame) -> DataFrame:
    """One row: status, labelled documents, balanced accuracy and macro F1."""
    sums = metrics.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("labeled_documents"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
    )
    agrees = (F.col("balanced_accuracy") >= ENOUGH_AGREEMENT) & (F.col("macro_f1") >= ENOUGH_AGREEMENT)
    status = (
        F.when(F.col("labeled_documents") == 0, NO_LABELS)
        .when(F.col("labeled_documents") < ENOUGH_LABELS, FEW_LABELS)
        .when(agrees, SUPPORTED)
        .otherwise(NOT_SUPPORTED)
    )
    return _with_meaning(sums.select(status.alias("status"), *sums.columns))


def unvalidated(spark: SparkSession) -> DataFrame:
    """The summary row of a corpus without a human-label column."""
    row = spark.createDataFrame(
        [(UNVALIDATED, 0, None, None)],
        "status string, labeled_documents long, balanced_accuracy double, macro_f1 double",
    )
    return _with_meaning(row)


def _with_meaning(row: DataFrame) -> DataFrame:
    meaning = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    return row.withColumn("meaning", F.element_at(meaning, F.col("status")))
