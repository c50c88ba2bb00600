"""Alignment of perturbed topics with the full-corpus topics."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIGNED_SCHEMA = "k int, iteration int, topic int, similarity double"


def best_matching(similarity: np.ndarray) -> list[int]:
    """The one-to-one matching of rows to columns with the largest sum (k <= 8).

    ``best[mask]`` is the largest sum matching the first rows to the columns in
    ``mask``.
    """
    k = len(similarity)
    best = {0: (0.0, ())}
    for row in range(k):
        following: dict[int, tuple[float, tuple[int, ...]]] = {}
        for mask, (value, chosen) in best.items():
            for column in range(k):
                bit = 1 << column
                if mask & bit:
                    continue
                offer = (value + float(similarity[row, column]), (*chosen, column))
                if mask | bit not in following or offer[0] > following[mask | bit][0]:
                    following[mask | bit] = offer
        best = following
    return list(best[(1 << k) - 1][1])


def _unit_rows(components: Iterable) -> np.ndarray:
    rows = np.vstack([np.asarray(row, dtype=float) for row in components])
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def align(pairs: DataFrame) -> DataFrame:
    """``k, iteration, topic, similarity`` of the matched topics of each repetition.

    ``pairs`` has one row per repetition and topic number (at most eight) with
    the ``reference`` and the ``candidate`` topic of that number.
    """

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("topic")
        similarity = _unit_rows(ordered["reference"]) @ _unit_rows(ordered["candidate"]).T
        chosen = similarity[np.arange(len(similarity)), best_matching(similarity)]
        return ordered[["k", "iteration", "topic"]].assign(similarity=chosen)

    return pairs.groupBy("k", "iteration").applyInPandas(matched, ALIGNED_SCHEMA)


def topic_stability(aligned: DataFrame) -> DataFrame:
    """Mean matched similarity of each topic over all repetitions."""
    return aligned.groupBy("k", "topic").agg(F.avg("similarity").alias("stability"))


def stability_by_count(aligned: DataFrame) -> DataFrame:
    """Mean and weakest topic average per topic count."""
    return (
        topic_stability(aligned)
        .groupBy("k")
        .agg(F.avg("stability").alias("mean_topic_stability"), F.min("stability").alias("minimum_topic_stability"))
    )
