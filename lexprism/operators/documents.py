"""From a source table to keyed documents and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TextConfig, require_columns
from ..functions import text as T
from ..session import evened, materialise


def _keeps_rows_apart(df: DataFrame, unit: str) -> bool:
    """True when the declared unit is present and unique on every row."""
    per_value = df.groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n"))
    row = per_value.agg(F.max("n").alias("n"), F.max(F.col("unit").isNull()).alias("gap")).first()
    return row["n"] == 1 and not row["gap"]


def with_document_key(df: DataFrame, unit: str | None, columns: dict[str, Column]) -> DataFrame:
    """Project ``columns`` next to a stable ``doc_key``.

    The declared unit is the key where it is unique; otherwise a number is
    assigned and written out once, because a generated number may change when
    a lost partition is computed again.
    """
    if unit and _keeps_rows_apart(df, unit):
        return evened(df.select(F.col(unit).alias("doc_key"), *[c.alias(name) for name, c in columns.items()]))
    named = df.select(*[c.alias(name) for name, c in columns.items()])
    return materialise(evened(named).withColumn("doc_key", F.monotonically_increasing_id()), "keyed")


def keyed_texts(df: DataFrame, config: TextConfig) -> DataFrame:
    """``doc_key, raw_text, label`` for every source row, blank ones included."""
    require_columns(df, text=config.text_column, unit=config.unit, group=config.group)
    label = T.group_label(config.group) if config.group else F.lit("")
    columns = {"raw_text": F.col(config.text_column).cast("string"), "label": label}
    return with_document_key(df, config.unit, columns)


def stopwords_of(config: TextConfig) -> list[str]:
    english: tuple[str, ...] = ()
    if config.use_english_stopwords:
        english = config.english_stopwords or T.english_stopwords()
    return T.stopword_list(english, config.custom_stopwords)


def token_table(keyed: DataFrame, config: TextConfig) -> DataFrame:
    """``doc_key, label, tokens`` for non-blank documents, stopwords removed."""
    prepared = keyed.select("doc_key", "label", T.lexical("raw_text").alias("lexical_text"))
    words = prepared.filter(F.col("lexical_text").isNotNull())
    found = words.select("doc_key", "label", T.tokens("lexical_text").alias("tokens"))
    return found.withColumn("tokens", T.without_stopwords("tokens", stopwords_of(config)))
