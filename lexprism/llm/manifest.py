"""A Merkle manifest of a table, with nested-interval labels.

Every node carries the interval of leaf ranks it covers. Nodes are grown in
bands of eight levels, each band in buckets of at most 256 members, so no task
holds more of a tree than a bucket. Going down again, the members of a bucket
are joined with its nodes by containment: the node of the next level that holds
a member's interval is its ancestor, and what that ancestor covers beside the
member is its sibling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

LEVELS = 8
LABEL = "tree string, lo long, hi long, leaves long"
PATH = "sides binary, siblings binary, subroot binary, root binary"
LEFT, RIGHT, ALONE = b"<", b">", b"-"  # on which side of a node its sibling stands


def field_text(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers are decimal."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (binary) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(field_text, fields)), 256))


def _join(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with lo, hi and leaves: each row's place in its tree by ``order``, nulls first, and the tree's size.

    Rows are sorted by ranges, and places are counted on from how many rows of
    the tree the ranges before hold; no tree is in one task.
    """
    keys = ["tree", *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranges").withColumn("part", F.shiftright("at", 33))
    held = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("tree")
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    offsets = held.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("leaves"))
    lo = F.col("at") + F.col("shift")
    return placed.join(offsets, ["tree", "part"]).select(*rows.columns, lo.alias("lo"), (lo + 1).alias("hi"), "leaves")


def _bucket(level: int) -> Column:
    return F.shiftright("lo", level + LEVELS).alias("bucket")


def _grown(members: DataFrame, level: int) -> DataFrame:
    """Nodes of the band above ``members``, which stand at ``level``; ``top`` marks the one of each bucket that goes on.

    A tree that has come to one node stays as it is.
    """

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        leaves, tree = table["leaves"][0].as_py(), table["tree"][0].as_py()
        lo, hi, digests = table["lo"].to_pylist(), table["hi"].to_pylist(), table["digest"].to_pylist()
        height, at, rows = (leaves - 1).bit_length(), level, []
        while at < min(level + LEVELS, height):
            at += 1
            digests = [_join(*digests[k : k + 2]) for k in range(0, len(digests), 2)]
            hi = [hi[min(k + 1, len(hi) - 1)] for k in range(0, len(hi), 2)]
            lo = lo[::2]
            rows += zip(lo, hi, digests, [at] * len(lo))
        rows = rows or [(lo[0], hi[0], digests[0], at)]
        column = [list(c) for c in zip(*rows)]
        top = [False] * (len(rows) - 1) + [True]
        return pa.table(
            [
                pa.array([tree] * len(rows)), pa.array(column[0], pa.int64()), pa.array(column[1], pa.int64()),
                pa.array([leaves] * len(rows), pa.int64()), pa.array(column[3], pa.int32()), pa.array(column[2], pa.binary()),
                pa.array(top),
            ],
            ["tree", "lo", "hi", "leaves", "level", "digest", "top"],
        )

    labelled = members.select("tree", "lo", "hi", "leaves", "digest")
    return labelled.groupBy("tree", _bucket(level)).applyInArrow(grow, f"{LABEL}, level int, digest binary, top boolean")


def _attached(members: DataFrame, nodes: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """``members`` at ``level`` with the path to the root: a containment join with the band's nodes, bucket by bucket.

    ``above`` holds the bucket's top with its own path. A path lists for each
    level the side of the sibling and its digest.
    """
    empty = [F.lit(None).cast("binary").alias(field.split()[0]) for field in PATH.split(", ")]
    inner = nodes.where("not top").select("tree", "lo", "hi", "level", "digest", *empty)
    tops = above.select("tree", "lo", "hi", F.lit(None).cast("int").alias("level"), "digest", *[f.split()[0] for f in PATH.split(", ")])

    def attach(mine: pa.Table, band: pa.Table) -> pa.Table:
        mine = mine.sort_by("lo")
        begin, end = mine["lo"].to_numpy(), mine["hi"].to_numpy()
        node_level = band["level"].fill_null(-1).to_numpy()
        node_lo, node_hi, node_digest = band["lo"].to_numpy(), band["hi"].to_numpy(), band["digest"].to_pylist()
        top = int(np.flatnonzero(node_level == -1)[0])
        path = {name: band[name][top].as_py() for name in ("sides", "siblings", "subroot", "root")}
        levels = [(begin, end, mine["digest"].to_pylist())]
        for k in sorted(set(node_level.tolist()) - {-1}):
            at = np.flatnonzero(node_level == k)
            at = at[np.argsort(node_lo[at])]
            levels.append((node_lo[at], node_hi[at], [node_digest[i] for i in at.tolist()]))
        if (mine["leaves"][0].as_py() - 1).bit_length() > level:  # else the tree is one node already
            levels.append((node_lo[top : top + 1], node_hi[top : top + 1], [node_digest[top]]))
        sides = [b""] * len(begin)
        siblings = [b""] * len(begin)
        lo, hi = begin, end
        for (own_lo, own_hi, own_digest), (up_lo, up_hi, _) in zip(levels, levels[1:]):
            holder = np.searchsorted(up_lo, begin, "right") - 1
            wide_lo, wide_hi = up_lo[holder], up_hi[holder]
            if not ((wide_lo <= lo) & (hi <= wide_hi)).all():
                raise ValueError("a node is not contained in one of the level above")
            before, after = lo > wide_lo, hi < wide_hi
            beside = np.searchsorted(own_lo, np.where(before, wide_lo, hi))
            for m, (b, a, s) in enumerate(zip(before.tolist(), after.tolist(), beside.tolist())):
                sides[m] += LEFT if b else RIGHT if a else ALONE
                siblings[m] += own_digest[s] if a or b else b""
            lo, hi = wide_lo, wide_hi
        added = [
            pa.array([s + path["sides"] for s in sides], pa.binary()), pa.array([s + path["siblings"] for s in siblings], pa.binary()),
            pa.array([path["subroot"]] * len(sides), pa.binary()), pa.array([path["root"]] * len(sides), pa.binary()),
        ]
        for name, column in zip(("sides", "siblings", "subroot", "root"), added):
            mine = mine.append_column(name, column)
        return mine

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    left = members.groupBy("tree", _bucket(level))
    return left.cogroup(inner.unionByName(tops).groupBy("tree", _bucket(level))).applyInArrow(attach, f"{kinds}, {PATH}")


class Forest:
    """Trees grown over ``members`` (tree, lo, hi, leaves, digest, ...), band by band, until each is one node.

    ``nodes`` has a table for each band: tree, lo, hi, leaves, level, digest, top.
    """

    def __init__(self, members: DataFrame):
        self.tiers, self.nodes = [members], []
        tallest = (members.agg(F.max("leaves")).first()[0] or 1) - 1
        for level in range(0, max(tallest.bit_length(), 1), LEVELS):
            self.nodes.append(materialise(_grown(self.tiers[-1], level), "nodes"))
            self.tiers.append(self.nodes[-1].where("top").select("tree", "lo", "hi", "leaves", "digest"))

    @property
    def roots(self) -> DataFrame:
        """tree, lo, hi, leaves and digest of the last node of every tree."""
        return self.tiers[-1]

    def paths(self, above: DataFrame) -> DataFrame:
        """The members with their path; ``above`` has the roots with the path that goes on from them."""
        for k in reversed(range(len(self.nodes))):
            above = _attached(self.tiers[k], self.nodes[k], above, k * LEVELS)
            if k:
                above = materialise(above, "paths")
        return above


def manifest_paths(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (tree, digest, ...) with lo, hi, leaves, sides, siblings, subroot and root.

    Within a tree leaves stand in ``order`` (nulls first); two neighbours make
    one node until one is left, the last of an odd number alone. The trees'
    roots, null first and then by the bytes of their names, make the tree above
    in the same way. Rows without a tree are a tree of their own. Equal rows
    stand beside each other in any order. Columns of ``leaves`` may not have the
    added names. An empty table gives an empty result.
    """
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("-")))
    trees = Forest(materialise(ranked(named, order), "leaves"))
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.col("leaves").alias("held"))
    whole = Forest(materialise(ranked(subroots, ["name"]), "subroots"))
    nothing = F.lit(b"")
    root = whole.roots.select(
        "tree", "lo", "hi", "leaves", "digest", nothing.alias("sides"), nothing.alias("siblings"),
        F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"),
    )
    tops = whole.paths(root).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("lo"), F.col("held").alias("hi"), F.col("held").alias("leaves"),
        "digest", "sides", "siblings", F.col("digest").alias("subroot"), "root",
    )
    found = trees.paths(materialise(tops, "paths"))
    return found.withColumn("tree", F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1)))


def folded(digest: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its path give."""
    at = 0
    for side in sides:
        beside = siblings[at : at + 32]
        if side == ALONE[0]:
            digest = _join(digest)
        else:
            digest = _join(beside, digest) if side == LEFT[0] else _join(digest, beside)
            at += 32
    return digest


def verified(paths: DataFrame, checked: str = "digest") -> DataFrame:
    """``paths`` with proof_sha256, folded_root (binary) and verified: each row's ``checked`` digest folded along its path.

    proof_sha256 is the digest of all siblings from the leaf up. No shuffle.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in (checked, "sides", "siblings", "root")]
            proofs = [hashlib.sha256(s.hex().encode()).digest() for s in columns[2]]
            roots = [folded(*row[:3]) for row in zip(*columns)]
            same = [a == b for a, b in zip(roots, columns[3])]
            added = [pa.array(proofs, pa.binary()), pa.array(roots, pa.binary()), pa.array(same, pa.bool_())]
            names = [*batch.schema.names, "proof_sha256", "folded_root", "verified"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInArrow(check, f"{kinds}, proof_sha256 binary, folded_root binary, verified boolean")


def dataset_manifest(
    df: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id",
    tree: str = "lang", tampered: Column | None = None, added: str = "n_chars",
) -> DataFrame:
    """id column, leaf, subroot, root, proof_sha256, folded_root (hexadecimal) and verified of every row.

    A leaf is the digest of the row's ``fields``. Where ``tampered`` holds, the
    leaf that is folded again has 1 more in the column ``added`` (null stays
    null), and the row is not verified. Leaves stand by id, nulls first, then by
    digest; repeated rows repeat. Only the named columns are read, so others may
    have any name. An empty table gives an empty result.
    """
    plain = {name: F.col(f"`{name}`") for name in fields}
    more = {added: (plain[added].cast("decimal(38,0)") + 1)} if added in plain else {}
    altered = leaf_digest([more.get(name, column) for name, column in plain.items()])
    leaves = df.select(
        F.col(f"`{tree}`").alias("tree"), F.col(f"`{id_column}`").alias("id"), leaf_digest(list(plain.values())).alias("digest"),
        (F.when(tampered, altered) if tampered is not None else F.lit(None).cast("binary")).alias("altered"),
    )
    paths = manifest_paths(materialise(leaves, "digests"), ["id", "digest"])
    found = verified(paths.withColumn("checked", F.coalesce("altered", "digest")), "checked")
    hexed = [F.lower(F.hex(old)).alias(new) for old, new in (
        ("digest", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof_sha256", "proof_sha256"), ("folded_root", "folded_root")
    )]
    return found.select(F.col("id").alias(id_column), *hexed, "verified")
