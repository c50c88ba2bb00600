"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidate vectors lie in blocks of postings: for each dimension the rows with a
weight there, and the weights. A query's weights are scattered one dimension at
a time into a dense array of scores, one for each row of the block; the block's
best rows are selected by partition and the blocks' best merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
QUERY_ROWS = 256
SLICE_ROWS = 65_536
PACKED = "slice int, rows int, ids binary, sizes binary, weights binary"


def quantised(vector: Column | str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold null or non-finite ones."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(usable, whole)


def _packed(rows: DataFrame, block: int, slices: int, every_slice: bool) -> DataFrame:
    """Rows (id, weights) as blocks, each for one slice in turn or for every slice.

    Weights travel as the non-zero ones of each dimension: rows and values.
    """

    def block_of(ids: list, vectors: list) -> tuple[int, bytes, bytes, bytes]:
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        flat = np.concatenate([np.asarray(v, np.int64) for v in vectors]) if len(vectors) else np.zeros(0, np.int64)
        return len(ids), np.asarray(ids, np.int64).tobytes(), sizes.tobytes(), flat.tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []
        turn = 0

        def flushed(n: int) -> pa.RecordBatch:
            nonlocal ids, vectors, turn
            count, *columns = block_of(ids[:n], vectors[:n])
            ids, vectors = ids[n:], vectors[n:]
            targets = range(slices) if every_slice else [hash((turn, int(np.frombuffer(columns[0], np.int64)[0]))) % slices]
            turn += 1
            arrays = [pa.array(list(targets), pa.int32()), pa.array([count] * len(targets), pa.int32())]
            arrays += [pa.array([c] * len(targets), pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, ["slice", "rows", "ids", "sizes", "weights"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += [np.asarray(v.values) for v in batch.column(1)]
            while len(ids) >= block:
                yield flushed(block)
        if ids:
            yield flushed(len(ids))

    return rows.mapInArrow(pack, PACKED)


class Postings:
    """A block of vectors, dimension by dimension."""

    def __init__(self, ids: bytes, sizes: bytes, weights: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        lengths, flat = np.frombuffer(sizes, np.int64), np.frombuffer(weights, np.int64)
        order = np.argsort(self.ids, kind="stable")  # equal scores then lie in order of id
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        self.ids = self.ids[order]
        owner = np.repeat(row, lengths)
        dimension = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        there = flat != 0
        owner, dimension, flat = owner[there], dimension[there], flat[there]
        by = np.argsort(dimension, kind="stable")
        self.dimensions, heads = np.unique(dimension[by], return_index=True)
        self.rows = np.split(owner[by], heads[1:])
        self.weights = np.split(flat[by], heads[1:])

    def scores(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Dense scores of all rows against one sparse query."""
        out = np.zeros(len(self.ids), np.int64)
        places = np.searchsorted(self.dimensions, terms)
        for place, term, value in zip(places.tolist(), terms.tolist(), values):
            if place < len(self.dimensions) and self.dimensions[place] == term:
                out[self.rows[place]] += self.weights[place] * value  # a row is named once in a posting list
        return out


def best_rows(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best rows but the query's own; rows lie in order of id, so the first of equals win."""
    usable = np.flatnonzero(ids != own)
    found = scores[usable]
    if len(found) > k:
        bar = np.partition(found, len(found) - k)[len(found) - k]
        above = np.flatnonzero(found > bar)
        level = np.flatnonzero(found == bar)[: k - len(above)]
        return usable[np.concatenate([above, level])]
    return usable


def _block_best(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Postings] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if last is None or last[0] != row["ids"]:
                    last = row["ids"], Postings(row["ids"], row["sizes"], row["weights"])
                block = last[1]
                query_ids = np.frombuffer(row["q_ids"], np.int64)
                lengths = np.frombuffer(row["q_sizes"], np.int64)
                flat = np.frombuffer(row["q_weights"], np.int64)
                ends = np.cumsum(lengths)
                out: list[list[np.ndarray]] = [[], [], []]
                for query, end, length in zip(query_ids.tolist(), ends.tolist(), lengths.tolist()):
                    values = flat[end - length : end]
                    terms = np.flatnonzero(values)
                    scores = block.scores(terms, values[terms])
                    best = best_rows(scores, block.ids, query, k)
                    out[0].append(np.full(len(best), query))
                    out[1].append(block.ids[best])
                    out[2].append(scores[best])
                if out[0]:
                    arrays = [pa.array(np.concatenate(column)) for column in out]
                    yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return search


def top_k(
    queries: DataFrame, candidates: DataFrame, vector: str = "embedding", id_column: str = "vec_id", k: int = 10,
    scale: int = 1024,
) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: each query's k best candidates, all if fewer.

    The score is the inner product of the quantised vectors (missing trailing
    components count as 0), equal scores go to the smaller id, and rows with the
    query's own id are not its candidates. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. An exactly
    repeated query row is one query; a repeated candidate row is a candidate
    each time. A query without candidates has no rows; empty tables give an
    empty result. Other columns are not read.

    Candidates are packed into blocks of 2,048 and dealt over slices of about
    65,536 rows; query blocks of 256 are copied to every slice and joined there,
    so no task holds more than a block of each, whatever the number of queries.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("long").alias("id"), quantised(vector, scale).alias("weights")).dropna()

    slices = max(16, -(-candidates.select(id_column).count() // SLICE_ROWS))
    blocks = _packed(usable(candidates), BLOCK_ROWS, slices, False)
    asked = usable(queries).distinct()
    asked = _packed(asked, QUERY_ROWS, slices, True).select(
        "slice", F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("weights").alias("q_weights")
    )
    found = blocks.join(asked, "slice").mapInArrow(_block_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
