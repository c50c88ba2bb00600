"""Exact-size document samples that do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ...config import SAMPLE_SHARE
from ...session import materialise

DIGITS_PER_STEP = 2  # hexadecimal: 256 buckets per sample and step
RANKED_AT_ONCE = 10_000
WINDOW = 8.0  # standard deviations

Fits = Sequence[tuple[int, int]]


def sample_size(topics: int, documents: int) -> int:
    return min(documents, max(8 * topics, math.ceil(SAMPLE_SHARE * documents)))


def draw(doc_key: Column, topics: Column, iteration: Column, seed: int) -> Column:
    """A fixed pseudo-random rank of a document within one sample."""
    parts = [doc_key.cast("string"), topics.cast("string"), iteration.cast("string"), F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def _inside(keys: DataFrame, open_buckets: dict[tuple[int, int], str], seed: int) -> DataFrame:
    """``k, iteration, drawn`` of the draws that start with the open bucket of their sample."""
    listed = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(i).alias("iteration"), F.lit(prefix).alias("prefix"))
            for (k, i), prefix in open_buckets.items()
        ]
    )
    drawn = F.transform(
        listed,
        lambda s: F.struct(
            s["k"].alias("k"),
            s["iteration"].alias("iteration"),
            s["prefix"].alias("prefix"),
            draw(F.col("doc_key"), s["k"], s["iteration"], seed).alias("drawn"),
        ),
    )
    return keys.select("doc_key", F.inline(drawn)).filter(F.startswith("drawn", "prefix"))


def _window(taken: int, documents: int) -> tuple[str, str]:
    """Hexadecimal bounds between which the last draw of a sample lies, but for odds of one in 10^15.

    Draws are spread evenly, so the draw of rank ``taken`` lies within a few
    standard deviations of ``taken / documents``.
    """
    share = taken / documents
    reach = WINDOW * math.sqrt(share * (1 - share) / documents) + WINDOW**2 / documents

    def digits(part: float) -> str:
        return "g" if part >= 1 else format(max(0, int(part * 2**64)), "016x")

    return digits(share - reach), digits(share + reach)


def sample_limits(keys: DataFrame, fits: Fits, documents: int, seed: int) -> dict[tuple[int, int], str]:
    """The largest draw inside each sample of the fixed size.

    One read: draws below a narrow window around the expected place are only
    counted, those inside it (some square roots of the documents) are written
    and ranked. A sample whose last draw lies elsewhere is found digit by digit.
    """
    if not fits or not documents:
        return {}
    bounds = [_window(sample_size(k, documents), documents) for k, _ in fits]
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in fits])
    drawn = F.transform(listed, lambda s: draw(F.col("doc_key"), s["k"], s["i"], seed)).alias("draws")
    low, high = (F.array(*[F.lit(bound[side]) for bound in bounds]) for side in (0, 1))
    seen = Observation()
    below = [F.count_if(F.get("draws", F.lit(at)) < bound[0]).alias(f"f{at}") for at, bound in enumerate(bounds)]
    read = keys.select(drawn).observe(seen, *below)
    near = F.filter(
        F.transform("draws", lambda d, at: F.struct(at.alias("fit"), d.alias("drawn"))),
        lambda s: (s["drawn"] >= F.get(low, s["fit"])) & (s["drawn"] < F.get(high, s["fit"])),
    )
    inside = materialise(read.select(F.inline(near)), "draws")
    counted = seen.get
    rank = {at: sample_size(k, documents) - counted[f"f{at}"] for at, (k, _) in enumerate(fits)}
    takes = F.array(*[F.lit(rank[at]).cast("long") for at in range(len(fits))])
    order = Window.partitionBy("fit").orderBy("drawn")
    ranked = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == F.get(takes, F.col("fit")))
    found = {tuple(fits[row["fit"]]): row["drawn"] for row in ranked.collect()}
    missed = [tuple(fit) for fit in fits if tuple(fit) not in found]
    return found | (_limits_by_digits(keys, missed, documents, seed) if missed else {})


def _limits_by_digits(keys: DataFrame, fits: Fits, documents: int, seed: int) -> dict[tuple[int, int], str]:
    """The same limits, counting draws by their leading digits.

    Each step looks only inside the bucket that holds the boundary, until that
    bucket is small enough to be ranked. A step shuffles at most 256 rows per
    sample and task.
    """
    open_buckets = {fit: "" for fit in fits}
    still = {(k, i): sample_size(k, documents) for k, i in fits}
    largest = documents
    digits = 0
    while largest > RANKED_AT_ONCE or digits == 0:
        digits += DIGITS_PER_STEP
        bucket = F.substring("drawn", 1, digits).alias("bucket")
        counted = _inside(keys, open_buckets, seed).groupBy("k", "iteration", bucket).agg(F.count("*").alias("n"))
        by_fit: dict[tuple[int, int], list] = {}
        for row in counted.orderBy("bucket").collect():
            by_fit.setdefault((row["k"], row["iteration"]), []).append((row["bucket"], row["n"]))
        largest = 0
        for fit, buckets in by_fit.items():
            for name, n in buckets:
                if n >= still[fit]:
                    open_buckets[fit] = name
                    largest = max(largest, n)
                    break
                still[fit] -= n
    takes = F.create_map(*[x for (k, i), n in still.items() for x in (F.lit(f"{k}:{i}"), F.lit(n))])
    order = Window.partitionBy("k", "iteration").orderBy("drawn")
    ranked = _inside(keys, open_buckets, seed).withColumn("rank", F.row_number().over(order))
    last = ranked.filter(F.col("rank") == F.element_at(takes, F.concat_ws(":", "k", "iteration")))
    return {(row["k"], row["iteration"]): row["drawn"] for row in last.collect()}


def membership(doc_key: Column, limits: dict[tuple[int, int], str], seed: int) -> Column:
    """One flag per sample, in the order of ``limits``."""
    listed = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(last).alias("last")) for (k, i), last in limits.items()]
    )
    return F.transform(listed, lambda s: draw(doc_key, s["k"], s["i"], seed) <= s["last"])


def sampled_documents(keys: DataFrame, fits: Fits, seed: int) -> DataFrame:
    """``k, iteration, doc_key`` of every document in every sample."""
    limits = sample_limits(keys, fits, keys.count(), seed)
    named = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("iteration")) for k, i in limits])
    flags = membership(F.col("doc_key"), limits, seed)
    inside = F.filter(F.arrays_zip(named.alias("fit"), flags.alias("inside")), lambda x: x["inside"])
    return keys.select("doc_key", F.inline(inside)).select("fit.k", "fit.iteration", "doc_key")
