"""Tables read off the fitted topics and the document weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ...functions import text as T
from ...functions.arrays import bind, total

DIVERSITY_TERMS = 10
NAMED_TERMS = 6
REPRESENTATIVES = 3


def topic_name(position):
    return F.concat(F.lit("Topic "), position.cast("string"))


def component_entries(components: DataFrame, *by: str) -> DataFrame:
    """Long form ``*by, topic, term_id, weight`` of topic rows held as arrays."""
    return components.select(*by, "topic", F.posexplode("weights").alias("term_id", "weight"))


def ranked_terms(entries: DataFrame, terms: DataFrame, limit: int, *by: str) -> DataFrame:
    """The heaviest terms of each topic with their rank; equal weights in term order.

    ``entries`` holds topics x vocabulary rows, at most 8 x 10,000 per fit.
    """
    named = entries.join(F.broadcast(terms.select("term_id", "term")), "term_id")
    order = Window.partitionBy(*by, "topic").orderBy(F.desc("weight"), "term")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_term_diversity(entries: DataFrame, terms: DataFrame, *by: str) -> DataFrame:
    """Share of different terms among the ten heaviest of every topic."""
    top = ranked_terms(entries, terms, DIVERSITY_TERMS, *by)
    share = F.count_distinct("term") / F.count("term")
    return top.groupBy(*by).agg(share.alias("top_term_diversity"))


def topic_terms(entries: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Weights scaled to sum to one within a topic, heaviest first."""
    whole = F.sum("weight").over(Window.partitionBy("topic"))
    scaled = entries.withColumn("whole", whole).withColumn(
        "weight", F.when(F.col("whole") > 0, F.col("weight") / F.col("whole")).otherwise(0.0)
    )
    ranked = ranked_terms(scaled.drop("whole"), terms, limit)
    return ranked.orderBy("topic", "rank").select(topic_name(F.col("topic")).alias("topic"), "rank", "term", "weight")


def document_shares(weights: DataFrame) -> DataFrame:
    """Replace ``topic_weights`` by ``shares`` that sum to one; all zero stays zero."""
    keep = [c for c in weights.columns if c != "topic_weights"]
    with_whole = F.struct(F.col("topic_weights").alias("w"), total("topic_weights").alias("whole"))
    shares = bind(
        with_whole, lambda s: F.transform(s["w"], lambda w: F.when(s["whole"] > 0, w / s["whole"]).otherwise(0.0))
    )
    return weights.select(*keep, shares.alias("shares"))


def document_topics(shares: DataFrame, topics: int, threshold: float) -> DataFrame:
    """Dominant topic (first of equals), strength, entropy and ambiguity per document."""
    strength = F.array_max("shares")
    parts = F.transform("shares", lambda s: F.when(s > 0, s * F.log(s + 1e-15)).otherwise(0.0))
    return shares.withColumn("assignment_strength", strength).select(
        "doc_key",
        F.array_position("shares", F.col("assignment_strength")).cast("int").alias("dominant"),
        topic_name(F.array_position("shares", F.col("assignment_strength"))).alias("topic"),
        "assignment_strength",
        (-total(parts) / F.lit(math.log(topics))).alias("normalized_entropy"),
        (F.col("assignment_strength") < threshold).alias("ambiguous"),
    )


def share_entries(shares: DataFrame, *keep: str) -> DataFrame:
    """Long form ``*keep, topic, share, dominant``, topics from 1."""
    dominant = F.array_position("shares", F.array_max("shares"))
    return shares.select(*keep, dominant.alias("dominant"), F.posexplode("shares").alias("position", "share")).select(
        *keep, (F.col("position") + 1).alias("topic"), "share", (F.col("dominant") == F.col("position") + 1).alias("leads")
    )


def topic_prevalence(shares: DataFrame) -> DataFrame:
    """Mean share and dominant documents per topic."""
    return (
        share_entries(shares)
        .groupBy("topic")
        .agg(
            F.avg("share").alias("mean_weight_share"),
            F.count_if("leads").alias("dominant_documents"),
            (F.count_if("leads") / F.count("*")).alias("dominant_document_share"),
        )
    )


def first_terms(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """``topic, top_terms``: the six heaviest terms of each topic in one string."""
    ranked = ranked_terms(entries, terms, NAMED_TERMS)
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy("topic").agg(F.array_join(F.transform(listed, lambda x: x["term"]), ", ").alias("top_terms"))


def variant_topic_prevalence(shares: DataFrame, levels: tuple[str, ...], topics: int) -> DataFrame:
    """Mean share of every topic within each comparison level."""
    labelled = shares.filter(F.col("label").isin(list(levels)))
    averages = [F.avg(F.get("shares", F.lit(i))).alias(f"Topic {i + 1}") for i in range(topics)]
    return (
        labelled.groupBy(F.col("label").alias("variant"))
        .agg(F.count("*").alias("documents"), *averages)
        .orderBy("variant")
    )


def top_documents(shares: DataFrame) -> DataFrame:
    """``topic, rank, doc_key, topic_weight``: the three largest shares per topic.

    The rank filter is applied within each task before rows move, so a topic
    sends three rows per task, not its documents.
    """
    order = Window.partitionBy("topic").orderBy(F.desc("share"), "doc_key")
    ranked = share_entries(shares, "doc_key").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= REPRESENTATIVES).select(
        "topic", "rank", "doc_key", F.col("share").alias("topic_weight")
    )


def representatives(shares: DataFrame, texts: DataFrame) -> DataFrame:
    """Masked snippets of the top documents. For local reading only, never exported.

    The at most 3 x 8 keys are looked up first, so the scan of the texts can
    skip what holds none of them.
    """
    top = top_documents(shares).collect()
    listed = shares.sparkSession.createDataFrame(
        top, S.StructType([S.StructField("topic", S.IntegerType()), S.StructField("rank", S.IntegerType()),
                           shares.schema["doc_key"], S.StructField("topic_weight", S.DoubleType())])
    )
    wanted = texts.filter(F.col("doc_key").isin([row["doc_key"] for row in top]))
    return (
        wanted.select("doc_key", "raw_text")
        .join(F.broadcast(listed), "doc_key")
        .orderBy("topic", "rank")
        .select(
            topic_name(F.col("topic")).alias("topic"),
            "rank",
            "topic_weight",
            T.snippet(T.normalized("raw_text")).alias("context_snippet_masked"),
        )
    )
