"""Vocabulary selection and the TF-IDF matrix.

Every document stays in its own row from tokens to weights: counting terms
inside a document needs no shuffle. The only shuffles are term totals, which
combine map-side to one row per term and task; pairs are counted by Arrow for
some documents at a time before that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIN_VOCABULARY, DataProblem, TextConfig
from ..functions.arrays import bind, double_literal
from ..functions.text import bigrams

BROADCAST_TERM_LIMIT = 200_000
SPREAD = 32
COUNTED_AT_ONCE = 500_000
PART_TOTALS = "term string, term_count long, document_frequency long"


@dataclass(frozen=True)
class Vocabulary:
    """At most ``max_features`` terms in term order, small enough for the driver."""

    terms: tuple[str, ...]
    counts: tuple[int, ...]
    frequencies: tuple[int, ...]
    documents: int
    ngram_max: int

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.documents) / (1 + df)) + 1.0 for df in self.frequencies]

    def table(self, spark) -> DataFrame:
        rows = [
            (i, *row) for i, row in enumerate(zip(self.terms, self.counts, self.frequencies, self.idf))
        ]
        schema = (
            "term_id int, term string, term_count long, document_frequency long, inverse_document_frequency double"
        )
        return spark.createDataFrame(rows, schema)


def _occurrences(df: DataFrame, terms: Column) -> DataFrame:
    """``term, before``: every occurrence next to its predecessor in the sorted document.

    Sorting the array inside the row puts repeats side by side, so the first
    occurrence in a document is visible without grouping by document.
    """
    ordered = df.select(F.sort_array(terms).alias("ordered"))
    shifted = F.concat(F.array(F.lit(None)), "ordered")
    pairs = F.inline(F.arrays_zip(F.col("ordered").alias("term"), shifted.alias("before")))
    return ordered.select(pairs).filter(F.col("term").isNotNull())


def _totals(occurrences: DataFrame) -> DataFrame:
    first_in_document = ~F.col("term").eqNullSafe(F.col("before"))
    return occurrences.groupBy("term").agg(
        F.count("*").alias("term_count"), F.count_if(first_in_document).alias("document_frequency")
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Terms of some documents end to end, and the document of each; about half a million terms at a time."""
    for batch in batches:
        lists = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(lists):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + COUNTED_AT_ONCE, "right")))
            terms = lists.slice(first, last - first).flatten()
            owner = np.repeat(np.arange(last - first), np.diff(ends[first:last], prepend=done))
            there = terms.is_valid()
            yield terms.filter(there), owner[there.to_numpy(zero_copy_only=False)]
            first = last


def _coded_totals(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes, how often each occurs, and in how many documents."""
    known, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    in_document = np.unique(owner.astype(np.int64) * max(1, len(known)) + place)
    return known, counts, np.bincount(in_document % max(1, len(known)), minlength=len(known))


def _part_totals(terms: pa.Array, counts: np.ndarray, frequencies: np.ndarray) -> pa.RecordBatch:
    columns = [terms, pa.array(counts, pa.int64()), pa.array(frequencies, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["term", "term_count", "document_frequency"])


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(
        F.sum("term_count").alias("term_count"), F.sum("document_frequency").alias("document_frequency")
    )


def term_totals(df: DataFrame, terms: Column) -> DataFrame:
    """``term, term_count, document_frequency`` over an array of terms per document."""
    return _totals(_occurrences(df, terms))


def _only_frequent_pairs(df: DataFrame, frequent: DataFrame) -> DataFrame:
    """Keep word pairs both of whose words are in ``frequent``.

    The list, too long to broadcast, meets the pairs by shuffle; what is left
    of a common word is spread by its partner.
    """
    left_word, right_word = F.substring_index("term", " ", 1), F.substring_index("term", " ", -1)
    named = df.withColumns({"left_word": left_word, "right_word": right_word})
    for own, other in (("left_word", "right_word"), ("right_word", "left_word")):
        copies = frequent.select(F.col("term").alias(own), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
        spread = named.withColumn("spread", F.pmod(F.hash(other), F.lit(SPREAD)))
        named = spread.join(copies, [own, "spread"], "left_semi").drop("spread")
    return named


def pair_totals(tokens: DataFrame, frequent: DataFrame, how_many: int) -> DataFrame:
    """Totals of adjacent pairs made of frequent words only.

    A pair occurs at most as often as either of its words, so no other pair can
    reach the count the frequent words already have; leaving it out before the
    shuffle is exact.
    """
    if how_many <= BROADCAST_TERM_LIMIT:
        listed = pa.array([row["term"] for row in frequent.collect()], pa.string())
        sent = tokens.sparkSession.sparkContext.broadcast(listed)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value
            for flat, owner in _pieces(batches):
                place = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy().astype(np.int64)
                pair = (owner[:-1] == owner[1:]) & (place[:-1] >= 0) & (place[1:] >= 0)
                codes = place[:-1][pair] * len(words) + place[1:][pair]
                known, *totals = _coded_totals(codes, owner[:-1][pair])
                left, right = (words.take(pa.array(side)) for side in np.divmod(known, max(1, len(words))))
                yield _part_totals(pc.binary_join_element_wise(left, right, " "), *totals)

        return _summed(tokens.select("tokens").mapInArrow(counted, PART_TOTALS))
    occurrences = _occurrences(tokens, bigrams("tokens"))
    return _totals(_only_frequent_pairs(occurrences, frequent))


def _ranked(terms: DataFrame, limit: int) -> DataFrame:
    return terms.orderBy(F.desc("term_count"), "term").limit(limit)


def fit_vocabulary(tokens: DataFrame, config: TextConfig, documents: int | None = None) -> Vocabulary:
    """Select terms by document frequency, then cap by total count.

    Reads ``tokens`` twice when pairs are wanted; pass a materialised table.
    """
    if documents is None:
        documents = tokens.count()
    most = config.max_df * documents
    if most < config.min_df:
        raise DataProblem("max_df leaves fewer documents than min_df asks for.")
    in_range = F.col("document_frequency") <= F.lit(most)
    words = term_totals(tokens, F.col("tokens")).filter(F.col("document_frequency") >= config.min_df).persist()
    try:
        candidates = words.filter(in_range)
        if config.ngram_max == 2:
            top = _ranked(candidates, config.max_features)
            floor = top.agg(F.count("*").alias("n"), F.min("term_count").alias("least")).first()
            least = floor["least"] if floor["n"] == config.max_features else config.min_df
            frequent = words.filter(F.col("term_count") >= least).select("term")
            pairs = pair_totals(tokens, frequent, frequent.count())
            kept = pairs.filter((F.col("document_frequency") >= config.min_df) & in_range)
            candidates = candidates.unionByName(kept)
        rows = _ranked(candidates, config.max_features).orderBy("term").collect()
    finally:
        words.unpersist()
    if not rows:
        raise DataProblem("No term survives the document-frequency limits.")
    return Vocabulary(
        terms=tuple(row["term"] for row in rows),
        counts=tuple(row["term_count"] for row in rows),
        frequencies=tuple(row["document_frequency"] for row in rows),
        documents=documents,
        ngram_max=config.ngram_max,
    )


def term_matrix(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_key, label, indices, counts, weights``: one row per non-blank document.

    Weights are (1 + ln n) * idf scaled to unit length; a document that keeps
    no term has empty arrays.
    """
    terms = F.col("tokens")
    if vocabulary.ngram_max == 2:
        terms = F.concat(terms, bigrams("tokens"))
    counter = CountVectorizerModel.from_vocabulary(list(vocabulary.terms), inputCol="terms", outputCol="bag")
    bags = counter.transform(tokens.select("doc_key", "label", terms.alias("terms")))
    sparse = bags.select("doc_key", "label", F.unwrap_udt("bag").alias("bag")).select(
        "doc_key", "label", F.col("bag.indices").alias("indices"), F.col("bag.values").alias("counts")
    )
    idf = double_literal(vocabulary.idf)
    scaled = sparse.withColumn(
        "scaled", F.zip_with("indices", "counts", lambda i, n: (F.lit(1.0) + F.log(n)) * F.get(idf, i))
    )
    with_norm = F.struct(
        F.col("scaled").alias("w"),
        F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda acc, w: acc + w * w)).alias("norm"),
    )
    unit_length = bind(with_norm, lambda s: F.transform(s["w"], lambda w: w / s["norm"]))
    return scaled.select(
        "doc_key",
        "label",
        "indices",
        F.col("counts").cast("array<long>").alias("counts"),
        unit_length.alias("weights"),
    )


def matrix_entries(matrix: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per document and term, without any shuffle."""
    return matrix.select(
        *keep,
        F.inline(
            F.arrays_zip(F.col("indices").alias("term_id"), F.col("counts").alias("n"), F.col("weights").alias("weight"))
        ),
    )


def vocabulary_table(matrix: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Terms with counts, document frequency, idf and mean weight over all non-blank documents."""
    sums = matrix_entries(matrix).groupBy("term_id").agg(F.sum("weight").alias("weight_sum"))
    return (
        F.broadcast(vocabulary.table(matrix.sparkSession))
        .join(sums, "term_id", "left")
        .select(
            "term",
            "term_count",
            "document_frequency",
            "inverse_document_frequency",
            (F.coalesce("weight_sum", F.lit(0.0)) / F.lit(vocabulary.documents)).alias("mean_tfidf"),
        )
        .orderBy(F.desc("mean_tfidf"), F.desc("term_count"), "term")
    )


def coverage(matrix: DataFrame) -> DataFrame:
    """One row: non-blank documents, those keeping a term, and their share."""
    usable = F.count_if(F.size("indices") > 0)
    return matrix.agg(
        F.count("*").alias("nonblank_documents"),
        usable.alias("usable_documents"),
        F.try_divide(usable, F.count("*")).alias("lexical_coverage"),
    )


def matrix_statistics(matrix: DataFrame, vocabulary_size: int) -> DataFrame:
    """One row: shape, stored entries, sparsity and Frobenius norm of the usable rows."""
    usable = matrix.filter(F.size("indices") > 0)
    squares = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w * w)
    entries = F.sum(F.size("indices")).cast("long")
    return usable.agg(F.count("*").alias("documents"), entries.alias("entries"), F.sum(squares).alias("squares")).select(
        "documents",
        F.lit(vocabulary_size).cast("long").alias("terms"),
        "entries",
        (1.0 - F.col("entries") / (F.col("documents") * F.lit(float(vocabulary_size)))).alias("sparsity"),
        F.sqrt("squares").alias("frobenius_norm"),
    )


def guardrails(matrix: DataFrame, vocabulary_size: int, config: TextConfig) -> DataFrame:
    """One row of counts with a pass flag for every rule a topic analysis needs."""
    minimum = config.minimum_documents
    smaller = F.least(F.col("usable_documents"), F.lit(vocabulary_size).cast("long"))
    return coverage(matrix).select(
        "nonblank_documents",
        "usable_documents",
        F.lit(vocabulary_size).cast("long").alias("vocabulary_size"),
        (F.col("nonblank_documents") >= minimum).alias("enough_documents"),
        (F.col("usable_documents") >= minimum).alias("enough_usable"),
        F.lit(vocabulary_size >= MIN_VOCABULARY).alias("enough_terms"),
        (F.lit(config.planned_topics) < smaller).alias("topics_fit"),
    )
