"""Non-negative factorisation of the TF-IDF rows, many fits per pass.

Document weights are a pure function of a row and the topics: a small
non-negative least-squares problem solved to convergence inside the task. No
per-document state is carried from pass to pass, so lineage stays flat and a
retried task gives the same contribution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from ...config import FIT_TOLERANCE, MAX_FIT_ITERATIONS
from .passes import BLOCK_CELLS, accumulate, blocks, chunks

TOPIC_SWEEPS = 4
ROW_SWEEPS = 500
ROW_TOLERANCE = 1e-9
FIRST_REACH = 0.5
MORE_REACH = 1.1
LESS_REACH = 0.5


@dataclass(frozen=True)
class Fit:
    """One factorisation; ``sample`` is a flag position, -1 for the full corpus.

    ``components`` is the point the next pass evaluates. It may lie ahead of
    ``settled``, the last topics known to lower the error to ``residual``.
    """

    topics: int
    iteration: int
    sample: int
    components: np.ndarray
    square_sum: float
    passes: int = 0
    converged: bool = False
    residual: float = float("inf")
    first_violation: float | None = None
    settled: np.ndarray | None = None
    reach: float = FIRST_REACH
    unfinished_rows: int = 0  # of the last pass

    @property
    def relative_error(self) -> float:
        return float(np.sqrt(max(self.residual, 0.0) / self.square_sum)) if self.square_sum else 0.0

    @property
    def capped(self) -> bool:
        return not self.converged


def solved_rows(images: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares for rows: minimise |x - wH| given xH' and HH'.

    ``images`` is (fits, rows, k), ``gram`` (fits, k, k). A row stops when its own
    weights no longer move, so its result does not depend on its neighbours.
    Returns the weights and, for each fit and row, whether it ran out of sweeps.
    """
    k = gram.shape[-1]
    diagonal = np.einsum("fkk->fk", gram)
    safe = np.where(diagonal > 0, diagonal, 1.0)
    ridge = 1e-10 * safe.max(axis=1)[:, None, None] * np.eye(k)
    weights = np.maximum(np.linalg.solve(gram + ridge, images.transpose(0, 2, 1)).transpose(0, 2, 1), 0.0)
    moving = np.ones(weights.shape[:2], bool)
    for _ in range(ROW_SWEEPS):
        moved = np.zeros(moving.shape)
        for j in range(k):
            slope = images[:, :, j] - (weights @ gram[:, :, j, None])[:, :, 0]
            value = np.maximum(weights[:, :, j] + slope / safe[:, None, j], 0.0)
            value *= diagonal[:, None, j] > 0
            step = np.where(moving, value - weights[:, :, j], 0.0)
            np.maximum(moved, np.abs(step), out=moved)
            weights[:, :, j] += step
        moving &= moved > ROW_TOLERANCE * np.maximum(weights.max(axis=2, initial=0.0), 1e-12)
        if not moving.any():
            break
    return weights, moving


def row_weights(images: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The weights alone."""
    return solved_rows(images, gram)[0]


def improved_topics(components: np.ndarray, weight_gram: np.ndarray, weight_image: np.ndarray) -> np.ndarray:
    """Coordinate sweeps over the topics given W'W and W'X."""
    topics = components.copy()
    for _ in range(TOPIC_SWEEPS):
        for j in range(len(topics)):
            if weight_gram[j, j] > 0:
                slope = weight_image[j] - weight_gram[j] @ topics
                topics[j] = np.maximum(topics[j] + slope / weight_gram[j, j], 0.0)
    return topics


def violation(components: np.ndarray, weight_gram: np.ndarray, weight_image: np.ndarray) -> float:
    """Size of the projected gradient: what keeps the topics from being optimal."""
    gradient = weight_gram @ components - weight_image
    held = (components <= 0) & (gradient > 0)
    return float(np.abs(np.where(held, 0.0, gradient)).sum())


def _one_pass(rows: DataFrame, fits: list[Fit], terms: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """W'W, W'X and the number of rows whose weights did not settle, for each fit."""
    by_topics: dict[int, list[int]] = {}
    for position, fit in enumerate(fits):
        by_topics.setdefault(fit.topics, []).append(position)
    groups = [
        (
            positions,
            [fits[p].sample for p in positions],
            np.stack([fits[p].components for p in positions]),
        )
        for positions in by_topics.values()
    ]
    broadcast = rows.sparkSession.sparkContext.broadcast(groups)

    def block_stats(dense: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for positions, samples, components in broadcast.value:
            count, k, terms = components.shape
            images = (dense @ components.reshape(count * k, terms).T).reshape(len(dense), count, k).transpose(1, 0, 2)
            weights, unfinished = solved_rows(images, components @ components.transpose(0, 2, 1))
            for f, sample in enumerate(samples):
                if sample >= 0:
                    weights[f] *= inside[:, sample, None]
                    unfinished[f] &= inside[:, sample]
            grams = weights.transpose(0, 2, 1) @ weights
            back = (weights.transpose(0, 2, 1).reshape(count * k, len(dense)) @ dense).reshape(count, k * terms)
            for f, position in enumerate(positions):
                out[position] = np.concatenate([[unfinished[f].sum()], grams[f].ravel(), back[f]])
        return [out[position] for position in range(len(out))]

    lengths = [1 + fit.topics * (fit.topics + terms) for fit in fits]
    stats = accumulate(rows, terms, lengths, block_stats)
    broadcast.destroy()
    found = []
    for fit, flat in zip(fits, stats):
        k = fit.topics
        found.append((flat[1 : 1 + k * k].reshape(k, k), flat[1 + k * k :].reshape(k, terms), int(flat[0])))
    return found


def _advance(fit: Fit, weight_gram: np.ndarray, weight_image: np.ndarray, unfinished: int = 0) -> Fit:
    """One step of a fit from the statistics of a pass.

    Each step goes on a little in the direction it moved. Where that raised the
    error the fit falls back to the settled topics, so the error of settled
    topics never rises.
    """
    topics = fit.components
    residual = (
        fit.square_sum
        - 2.0 * float((topics * weight_image).sum())
        + float((weight_gram * (topics @ topics.T)).sum())
    )
    seen = replace(fit, passes=fit.passes + 1, unfinished_rows=unfinished)
    if residual > fit.residual and topics is not fit.settled:
        return replace(seen, components=fit.settled, reach=fit.reach * LESS_REACH)
    gap = violation(topics, weight_gram, weight_image)
    first = gap if fit.first_violation is None else fit.first_violation
    seen = replace(seen, residual=residual, first_violation=first)
    if gap <= FIT_TOLERANCE * first:
        return replace(seen, converged=True)
    if seen.passes >= MAX_FIT_ITERATIONS:
        return seen
    better = improved_topics(topics, weight_gram, weight_image)
    before = topics if fit.settled is None else fit.settled
    ahead = np.maximum(better + fit.reach * (better - before), 0.0)
    return replace(seen, components=ahead, settled=better, reach=min(1.0, fit.reach * MORE_REACH))


def factorise(rows: DataFrame, fits: list[Fit]) -> list[Fit]:
    """Run every fit to convergence or the cap; finished fits drop out of later passes."""
    terms = fits[0].components.shape[1]
    done: list[Fit] = []
    for chunk in chunks([fit.components.nbytes for fit in fits]):
        running = fits[chunk]
        while running:
            stats = _one_pass(rows, running, terms)
            stepped = [_advance(fit, *found) for fit, found in zip(running, stats)]
            done += [f for f in stepped if f.converged or f.passes >= MAX_FIT_ITERATIONS]
            running = [f for f in stepped if not f.converged and f.passes < MAX_FIT_ITERATIONS]
    return sorted(done, key=lambda f: (f.topics, f.iteration))


def document_weights(rows: DataFrame, components: np.ndarray) -> DataFrame:
    """``doc_key, label, topic_weights``: one non-negative vector per row of ``rows``."""
    terms = components.shape[1]
    broadcast = rows.sparkSession.sparkContext.broadcast(components)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = broadcast.value
        gram = (topics @ topics.T)[None]
        size = max(1, BLOCK_CELLS // terms)
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                piece = batch.slice(first, size)
                for dense, _ in blocks(iter([piece]), terms):
                    weights = row_weights((dense @ topics.T)[None], gram)[0]
                    bounds = pa.array(np.arange(0, weights.size + 1, len(topics)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_key"),
                            piece.column("label"),
                            pa.ListArray.from_arrays(bounds, pa.array(weights.ravel())),
                        ],
                        names=["doc_key", "label", "topic_weights"],
                    )

    schema = S.StructType(
        [rows.schema["doc_key"], rows.schema["label"], S.StructField("topic_weights", S.ArrayType(S.DoubleType()))]
    )
    return rows.select("doc_key", "label", "indices", "weights", "member").mapInArrow(task, schema)
