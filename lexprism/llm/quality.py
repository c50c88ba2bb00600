"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 18
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_DRAW = np.random.default_rng(20240229)
_BYTE_MIX = _DRAW.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_PLACE_MIX = _DRAW.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's words and word pairs, and their damped counts scaled to length one.

    A word is a run of letters, of digits or of other marks, case kept. All
    pairs of equal words share one more bucket. An empty text has no features.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _KIND[data]
    heads = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(data) else np.zeros(0, np.int64)
    if not len(heads):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    place = np.arange(len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
    words = np.add.reduceat(_BYTE_MIX[data] * _PLACE_MIX[place & 63], heads)[kind[heads] != _SPACE]
    words ^= words >> np.uint64(29)
    again = np.full(np.count_nonzero(words[:-1] == words[1:]), _PAIR)  # a pair of equal words is also counted as such
    grams = np.concatenate([words, words[:-1] * _PAIR + words[1:], again])
    buckets = ((grams * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    buckets, counts = np.unique(buckets, return_counts=True)
    if not len(buckets):
        return buckets, np.zeros(0, np.float32)
    values = 1.0 + np.log(counts)
    return buckets, (values / np.sqrt((values**2).sum())).astype(np.float32)


@dataclass(frozen=True)
class FtrlRules:
    """Step sizes and penalties of the per-coordinate updates, and passes over the sample."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    passes: int = 4


@dataclass(frozen=True)
class Model:
    """A weight for each bucket, and the constant."""

    weights: np.ndarray
    constant: float

    def score(self, text: str | None) -> float:
        buckets, values = features(text)
        margin = self.constant + float(self.weights[buckets].astype(np.float64) @ values)
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0))))


def _fitted(labels: np.ndarray, buckets: list[np.ndarray], values: list[np.ndarray], rules: FtrlRules) -> tuple[np.ndarray, float]:
    """Follow the regularised leader over the examples in order; the constant carries no penalty."""
    z, n = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    constant, constant_n = 0.0, 0.0

    def weight(z_part: np.ndarray, n_part: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z_part) * np.maximum(np.abs(z_part) - rules.l1, 0.0)
        return -shrunk / ((rules.beta + np.sqrt(n_part)) / rules.alpha + rules.l2)

    for _ in range(rules.passes):
        for label, at, value in zip(labels, buckets, values):
            z_part, n_part = z[at], n[at]
            w = weight(z_part, n_part)
            p = 1.0 / (1.0 + np.exp(-np.clip(constant + w @ value, -35.0, 35.0)))
            gradient = (p - label) * value
            grown = n_part + gradient**2
            z[at] = z_part + gradient - (np.sqrt(grown) - np.sqrt(n_part)) / rules.alpha * w
            n[at] = grown
            constant_n += (p - label) ** 2
            constant -= rules.alpha / (rules.beta + np.sqrt(constant_n)) * (p - label)
    return weight(z, n).astype(np.float32), constant


def in_fold(id_column: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves ``fold`` modulo ``folds``; null ids are in no fold."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    held_out_fold: int = 0,
    max_examples: int = 8_000,
    rules: FtrlRules = FtrlRules(),
) -> Model:
    """Learn from at most ``max_examples`` labelled rows outside the held-out fold.

    The sample is the labelled ids of smallest hash, so it depends neither on
    partitions nor on order. Only it meets one task, as hashed features. An id
    with several labels takes their mean, rounded up; of several texts of one id
    that of the smallest hash is learned from, so the bound holds. Null ids and labels take
    no part. Without examples, or with one class only, all weights are 0 and the
    constant is that of the class shares (score 0.5 without any).
    """
    usable = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~in_fold(id_column, folds, held_out_fold))
    marked = usable.groupBy(id_column).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("__label"))
    known = marked.join(docs.select(id_column).where(F.col(id_column).isNotNull()).distinct(), id_column, "left_semi")
    order = F.xxhash64(F.col(id_column).cast("string"), F.lit(11))
    sample = known.orderBy(order, id_column).limit(max_examples)
    texts = docs.select(F.col(id_column), F.col(text).cast("string").alias("__text"))
    chosen = texts.join(F.broadcast(sample), id_column).select(
        order.alias("__order"), "__label", F.xxhash64("__text").alias("__hash"), F.col(id_column).cast("string").alias("__id"), "__text"
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(4)]
            columns = [*batch.columns[:4], pa.array([b for b, _ in found], pa.list_(pa.int32())),
                       pa.array([v for _, v in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "label", "hash", "id", "buckets", "values"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(size=rows["buckets"].map(len)).sort_values(["place", "label", "size"], kind="stable")
        goal = rows["label"].to_numpy(np.float64)
        if goal.min() == goal.max():
            return pd.DataFrame({"weights": [np.zeros(1 << BUCKET_BITS, np.float32).tobytes()], "constant": [35.0 * (2 * goal[0] - 1)]})
        weights, constant = _fitted(goal, list(rows["buckets"]), list(rows["values"]), rules)
        return pd.DataFrame({"weights": [weights.tobytes()], "constant": [constant]})

    seen = chosen.mapInArrow(hashed, "place long, label int, hash long, id string, buckets array<int>, values array<float>")
    examples = seen.groupBy("id").agg(F.min(F.struct("place", "label", "hash", "buckets", "values")).alias("one")).select("one.*")
    fitted = examples.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights binary, constant double").first()
    if fitted is None:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(fitted["weights"]), np.float32), fitted["constant"])


def score_quality(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3
) -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 from ``threshold`` on) of every row's whole text.

    A null or empty text scores what the constant says. Rows are independent:
    repeated rows repeat, an empty table stays empty, other columns are not
    read. One pass; the model (1 MB) travels with the tasks.
    """
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.score(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.float64)
            columns = [*batch.columns[:-1], pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score", "predicted"])

    return chosen.mapInArrow(score, f"{schema}, score double, predicted int")


def keep_quality(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that the model does not reject, all columns unchanged."""

    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) >= threshold for t in texts], dtype=bool)

    good.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.where(F.pandas_udf(good, "boolean")(F.col(text).cast("string")))
