"""A training corpus from raw documents: quality, near copies, secrets, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexprism.llm.mixing import mix_sources, with_tokens
from lexprism.llm.packing import pack
from lexprism.llm.quality import keep_quality, train_quality
from lexprism.llm.secrets import redact_secrets
from lexprism.llm.simhash import deduplicated
from lexprism.session import materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside its held-out fold."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_quality(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (four-word shingles) link at four bits or fewer."""
    return deduplicated(docs, words_each=4, reach=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of found secrets replaced and n_chars set anew."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources as often as their tempered weight asks; shares are of tokens."""
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), "doc_id", "source", "text")
    counted = with_tokens(rows, TOKENIZER, ("row", "doc_id", "source"))
    drawn = mix_sources(counted, tokens=F.col("n_tokens"), target_entropy=None, toward_even=0.5)
    return drawn.select("row.*")  # whole rows went through as one column, so their names met none of the operators'


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return pack(docs, TOKENIZER, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None  # SQL can express neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
