"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round orders the nodes anew by a hash. Every node points to its
    neighbour of the lowest place if that is below its own, pointers are
    followed twice more, and links are drawn between what their ends point to.
    As the order has nothing to do with how nodes are linked, a round leaves
    about a third of the nodes of a chain, and rounds grow with the logarithm of
    the longest one. Only minima are aggregated, so a node with very many links
    costs one row for each task. Both tables are written each round.
    """
    left = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, turn = None, 0
    while not left.isEmpty():
        turn += 1
        place = lambda name: F.struct(F.xxhash64(name, F.lit(turn)).alias("h"), F.col(name).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(place("b")).alias("low"))
        first = lowest.select(F.col("a").alias("node"), F.least("low", place("a"))["node"].alias("root"))
        pointers = materialise(first, "pointers")
        for _ in range(2):
            ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            pointers = pointers.join(ahead, "root").select("node", F.col("next").alias("root"))
            pointers = materialise(pointers, "pointers")
        if roots is None:
            roots = pointers
        else:
            moved = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = materialise(roots, "roots")
        for end in ("a", "b"):
            moved = pointers.select(F.col("node").alias(end), F.col("root").alias("next"))
            left = left.join(moved, end).withColumn(end, F.col("next")).drop("next")
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = materialise(left.distinct(), "links")
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
