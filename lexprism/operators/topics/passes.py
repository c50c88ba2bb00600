"""One pass over the document rows for many fits at once.

A task streams its rows in blocks, turns each block into a small dense array
and adds up fixed-size statistics per fit. What leaves a task is one packed
array, never anything per document, and partial sums are added on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_CELLS = 6_000_000
CHUNK_BYTES = 64 * 1024 * 1024
SPREAD = 64
PIECE = 65_536
ON_DRIVER_BYTES = 256 * 1024
PARTIAL_SCHEMA = "piece int, spread int, partition int, stats binary"

Block = tuple[np.ndarray, np.ndarray]


def blocks(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[Block]:
    """Dense rows (n x terms) and sample flags (n x samples) of each block."""
    size = max(1, BLOCK_CELLS // terms)
    for batch in batches:
        indices, weights, member = (batch.column(name) for name in ("indices", "weights", "member"))
        for first in range(0, batch.num_rows, size):
            idx, val, flags = (column.slice(first, size) for column in (indices, weights, member))
            rows = len(idx)
            dense = np.zeros((rows, terms))
            owner = np.repeat(np.arange(rows), idx.value_lengths().to_numpy())
            dense[owner, idx.flatten().to_numpy()] = val.flatten().to_numpy()
            inside = flags.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            yield dense, inside


def chunks(sizes: list[int]) -> Iterator[slice]:
    """Consecutive slices whose sizes in bytes add up to at most one chunk."""
    first = held = 0
    for position, size in enumerate(sizes):
        if position > first and held + size > CHUNK_BYTES:
            yield slice(first, position)
            first, held = position, 0
        held += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _added(table: pa.Table) -> np.ndarray:
    """Sum of the packed arrays in one group of partial sums, in the order of their partitions."""
    total: np.ndarray | None = None
    stats = table.column("stats")
    for at in np.argsort(table.column("partition").to_numpy()):
        part = np.frombuffer(stats[int(at)].as_buffer())
        total = part.copy() if total is None else total + part
    return total


def _merge(partial: DataFrame, *keys: str) -> DataFrame:
    def merged(table: pa.Table) -> pa.Table:
        head = {key: table.column(key).slice(0, 1) for key in ("piece", "spread")}
        head["partition"] = pa.array([pc.min(table.column("partition")).as_py()], pa.int32())
        return pa.table({**head, "stats": pa.array([_added(table).tobytes()], pa.binary())})

    merged.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return partial.groupBy(*keys).applyInArrow(merged, PARTIAL_SCHEMA)


def accumulate(
    rows: DataFrame,
    terms: int,
    lengths: list[int],
    block_stats: Callable[[np.ndarray, np.ndarray], list[np.ndarray]],
) -> list[np.ndarray]:
    """Sum the arrays ``block_stats`` returns (of these lengths) over all rows.

    The result is bounded by fits x topics x vocabulary, which the caller keeps
    below the chunk limit. Partial sums travel packed and cut into pieces of
    equal length, so the adding is spread over tasks and the driver gets one
    array a pass, however many tasks there are. Only where all partial sums
    together are as small as some counts are they added on the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: list[np.ndarray] | None = None
        for dense, inside in blocks(batches, terms):
            found = block_stats(dense, inside)
            if sums is None:
                sums = found
            else:
                for held, new in zip(sums, found):
                    held += new
        if sums is None:
            return
        flat = np.concatenate(sums)
        pieces = [flat[first : first + PIECE].tobytes() for first in range(0, len(flat), PIECE)]
        partition = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(pieces)), pa.int32()),
                pa.array([partition % SPREAD] * len(pieces), pa.int32()),
                pa.array([partition] * len(pieces), pa.int32()),
                pa.array(pieces, pa.binary()),
            ],
            names=["piece", "spread", "partition", "stats"],
        )

    partial = rows.select("indices", "weights", "member").mapInArrow(task, PARTIAL_SCHEMA)
    partitions, size = rows.rdd.getNumPartitions(), sum(lengths)
    if partitions > 1 and partitions * size * 8 > ON_DRIVER_BYTES:
        if partitions > SPREAD:
            partial = _merge(partial, "piece", "spread")
        partial = _merge(partial, "piece")
    flat = np.zeros(size)
    for batch in partial.toArrow().to_batches():
        for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("stats")):
            part = np.frombuffer(packed.as_buffer())
            flat[piece * PIECE : piece * PIECE + len(part)] += part
    return np.split(flat, np.cumsum(lengths)[:-1])
