"""SimHash fingerprints and near-duplicate components.

Fingerprints are embedded as the number of set bits in each of 32 segments. Two
fingerprints that differ in d bits lie at a Manhattan distance of at most d
there. The axes are dealt to groups, more than the reach by a few: a distance
within reach leaves so many groups without any, so a near pair shares the grid
cell of some choice of groups. What shares a cell is verified on the
fingerprints themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
SEGMENTS, SEGMENT_BITS = 32, 2
SPARE_GROUPS = 2
BLOCK = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8) * 256


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """SimHash of a text's word shingles as an unsigned number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    spaced = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    count = max(1, len(words) - words_each + 1)
    digest = xxhash.xxh64_intdigest
    cuts = zip(begins[:count].tolist(), ends[-count:].tolist())
    hashes = np.array([digest(spaced[a:b], SEED) for a, b in cuts], "<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BITS * 2 > count).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", words_each: int = 4) -> DataFrame:
    """The id column and ``print``, the fingerprint as a signed long, of every row's whole text. No shuffle."""
    chosen = df.select(F.col(id_column), F.col(text).cast("string").alias("__text"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words_each) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_column, "print"])

    return chosen.mapInArrow(convert, f"`{id_column}` {chosen.schema[id_column].dataType.simpleString()}, print long")


def cells(reach: int, spare: int = SPARE_GROUPS) -> list[tuple[int, ...]]:
    """The axes of each cell: every choice of ``spare`` out of ``reach + spare`` groups of axes."""
    groups = reach + spare
    if groups > SEGMENTS:
        raise ValueError(f"a reach above {SEGMENTS - spare} bits leaves no axes to compare")
    dealt = [tuple(range(g, SEGMENTS, groups)) for g in range(groups)]
    return [sum(chosen, ()) for chosen in itertools.combinations(dealt, spare)]


def cell_keys(column: Column, reach: int, spare: int = SPARE_GROUPS) -> Column:
    """A fingerprint's cell for each choice of groups: the number of the choice, and the counts on its axes by a 64-bit hash.

    A count is that of the set bits of a segment: 0, 1 or 2. Two unequal cells
    of one hash are only compared in vain.
    """
    low = F.lit(0x5555555555555555)
    first, second = column.bitwiseAND(low), F.shiftrightunsigned(column, 1).bitwiseAND(low)
    ones = first.bitwiseXOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))  # counts of all segments, two bits each
    masks = [sum(3 << SEGMENT_BITS * axis for axis in axes) for axes in cells(reach, spare)]
    signed = [mask - 2**64 if mask >= 2**63 else mask for mask in masks]
    return F.array(*[F.xxhash64(ones.bitwiseAND(F.lit(mask)), F.lit(number)) for number, mask in enumerate(signed)])


def forest(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what links of the block pair hold together: each node to its smallest."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= reach
    i, j = np.nonzero(near)
    if not len(i):
        return a[:0], a[:0]
    names, place = np.unique(np.concatenate([a[i], b[j]]).view(np.int64), return_inverse=True)
    u, v = place[: len(i)], place[len(i) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        fresh = label.copy()
        np.minimum.at(fresh, u, low)
        np.minimum.at(fresh, v, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def _verified(met: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) that hold together what is near between ``probes`` and ``prints`` of each row."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            probes, others = batch.column(0), batch.column(1)
            flat_a = probes.flatten().to_numpy().view(np.uint64)
            flat_b = others.flatten().to_numpy().view(np.uint64)
            at_a, at_b = (np.append(0, np.cumsum(side.value_lengths().to_numpy())).tolist() for side in (probes, others))
            for k in range(batch.num_rows):
                links = forest(flat_a[at_a[k] : at_a[k + 1]], flat_b[at_b[k] : at_b[k + 1]], reach)
                if len(links[0]):
                    found.append(links)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side).view(np.int64)) for side in zip(*found)], ["a", "b"])

    return met.mapInArrow(verify, "a long, b long")


def _small_cells(placed: DataFrame, reach: int) -> DataFrame:
    """Links within the cells of ``placed`` (cell, print), none of them large; rows are sorted by cell and looked at in runs."""

    def links(cell: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(begin, len(cell)))
        two = begin[sizes == 2]  # most cells that hold more than one print hold two
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= reach]
        found = [(prints[two].view(np.int64), prints[two + 1].view(np.int64))]
        for at, size in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = prints[at : at + size]
            found.append(forest(part, part, reach))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found)], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # the run that may go on in the next batch
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(cell, cell[-1])
            if last:
                yield links(cell[:last], prints[:last])
                cell, prints = cell[last:], prints[last:]
        if len(cell):
            yield links(cell, prints)

    dealt = placed.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(verify, "a long, b long")


def near_links(prints: DataFrame, reach: int = 4) -> DataFrame:
    """Links (a, b) between different fingerprints of ``prints`` (print long, each once).

    Two fingerprints are connected by these links if and only if they are by
    steps of at most ``reach`` differing bits; chains stand for the pairs within
    one cell. Cells of more than about a thousand fingerprints are cut into
    blocks, each pair of which is a task row of its own.
    """
    keyed = prints.select("print", F.explode(cell_keys(F.col("print"), reach)).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    large = materialise(sizes.select("cell", F.ceil(F.col("held") / BLOCK).cast("int").alias("pieces")), "large")
    placed = keyed.join(large, "cell", "left")
    links = _small_cells(placed.where("pieces is null").select("cell", "print"), reach)
    if large.isEmpty():
        return links
    piece = F.pmod(F.xxhash64("print", F.lit(7)), F.col("pieces")).cast("int")
    blocks = placed.where("pieces is not null").groupBy("cell", piece.alias("piece")).agg(
        F.collect_list("print").alias("prints"), F.first("pieces").alias("pieces")
    )
    blocks = materialise(blocks, "blocks")
    probing = blocks.select("cell", F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("piece"), F.col("prints").alias("probes"))
    met = probing.join(blocks.select("cell", "piece", "prints"), ["cell", "piece"])
    return links.unionByName(_verified(met.select("probes", "prints"), reach))


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words_each: int = 4, reach: int = 4
) -> DataFrame:
    """The id column, ``print`` (signed long) and ``component_id`` of every row.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; the
    fingerprint is that of their shingles of ``words_each`` words, repeats
    included (fewer words: one shingle; none, also null: 0). Rows link where
    fingerprints differ in at most ``reach`` bits; component_id is the smallest
    id reachable over links, the row's own included. Rows with null ids take
    part as stepping stones but name no component (null if it has no other id).
    Repeated rows repeat in the result. Equal fingerprints are one node, so
    copies add no links. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(df, id_column, text, words_each), "prints")
    nodes = materialise(prints.groupBy("print").agg(F.min(id_column).alias("first_id")), "nodes")
    roots = components(materialise(near_links(nodes.select("print"), reach), "near"))
    named = nodes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left")
    named = materialise(named.select("print", "first_id", F.coalesce("root", "print").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = named.join(least, "root").select("print", "component_id")
    return prints.join(component, "print").select(id_column, "print", "component_id")


def deduplicated(df: DataFrame, id_column: str = "doc_id", text: str = "text", words_each: int = 4, reach: int = 4) -> DataFrame:
    """``df`` with one document of each near-duplicate component: that of the smallest id.

    Rows without an id come after those with one; rows of one id, and rows
    without, go by a 128-bit hash of their text. So each component keeps exactly
    one row, of equal rows too. Column names of ``df`` meet none of ours. An
    empty table gives an empty result.
    """
    own, words = F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("string")
    marks = [F.xxhash64(F.lit(seed), own, words).alias(name) for seed, name in ((1, "one"), (2, "two"))]
    keyed = df.select(F.struct(own.isNull().alias("lost"), own.alias("id"), *marks).alias("key"), words.alias("text"))
    found = near_duplicates(keyed, "key", "text", words_each, reach)
    first = found.where("key = component_id").select("key.one", "key.two").distinct()
    rows = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"), *marks)
    return rows.join(first, ["one", "two"], "left_semi").dropDuplicates(["one", "two"]).select("row.*")
