"""Token counts by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch that were not met before lie in one flat array of
symbols. In each round every sequence finds its pair of lowest rank and joins
all places of that pair at once; sequences without a pair left are counted
and leave. A pair that a round creates has a higher rank than the pair joined,
so joining all places of one pair together gives what joining them one by one
gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .pretokens import Vocabulary, chunks, split, vocabulary

NONE = np.int32(2**31 - 1)
TABLE_BITS = 18
KEPT_WORDS = 500_000


class PairTable:
    """Rank and result of each mergeable pair, in an open-addressed table of arrays."""

    def __init__(self, known: Vocabulary):
        keys = (known.left << 17) | known.right
        self.merged = known.merged
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.ranks = np.full(1 << TABLE_BITS, NONE, np.int32)
        place, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[place[open_]] == -1]
            _, firsts = np.unique(place[free], return_index=True)
            put = free[firsts]
            self.keys[place[put]], self.ranks[place[put]] = keys[put], put
            open_ = open_[self.keys[place[open_]] != keys[open_]]
            place[open_] = (place[open_] + 1) & ((1 << TABLE_BITS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 17) | right
        place = self._slot(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.ranks[place], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << TABLE_BITS) - 1)
            there = self.keys[place[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[place[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


_TABLES, _KNOWN = Memo(), Memo()


def pair_table(path: str) -> PairTable:
    return _TABLES.made(path, lambda: PairTable(vocabulary(path)))


def surviving_symbols(words: list[str], path: str) -> np.ndarray:
    """Number of symbols left of each word after all merges."""
    table = pair_table(path)
    parts = [word.encode("utf-8", "surrogatepass") for word in words]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    symbol = vocabulary(path).byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
    owner = np.repeat(np.arange(len(parts)), lengths)
    counts = lengths.copy()
    if len(symbol) < 2:
        return counts
    rank = np.full(len(symbol), NONE, np.int32)  # of the pair that begins here
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner] = table.rank(symbol[inner], symbol[inner + 1])
    while len(symbol):
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(symbol)))
        live = lowest != NONE
        counts[owner[heads[~live]]] = sizes[~live]
        spread = np.repeat(np.where(live, lowest, NONE - 1), sizes)  # NONE - 1 is nobody's rank
        chosen = rank == spread
        run_start = chosen.copy()
        run_start[1:] &= ~chosen[:-1]
        places = np.flatnonzero(chosen)
        begun = np.maximum.accumulate(np.where(run_start, np.arange(len(symbol)), 0))
        places = places[(places - begun[places]) % 2 == 0]  # in a run like aaaa every other place
        symbol[places] = table.merged[rank[places]]
        stay = np.repeat(live, sizes)
        stay[places + 1] = False
        moved = np.cumsum(stay) - 1
        symbol, owner, rank, fresh = symbol[stay], owner[stay], rank[stay], moved[places]
        if not len(symbol):
            break
        touched = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
        ends = touched == len(symbol) - 1
        rank[touched] = NONE
        touched = touched[~ends]
        touched = touched[owner[touched] == owner[touched + 1]]
        rank[touched] = table.rank(symbol[touched], symbol[touched + 1])
    return counts


def counted(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text; special strings inside a text count one each."""
    known, totals = vocabulary(path), np.zeros(len(texts), np.int64)
    seen = _KNOWN.made(path, dict)
    for first, group in chunks(texts):
        words, before, owners = split(group, known)
        if len(seen) > KEPT_WORDS:
            seen.clear()
        fresh = list(set(words).difference(seen))
        seen.update(zip(fresh, surviving_symbols(fresh, path).tolist()))
        sizes = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        summed = np.append(0, np.cumsum(sizes))
        per_segment = summed[before[1:]] - summed[before[:-1]]
        for (place, special), n in zip(owners, per_segment.tolist()):
            totals[first + place] += n + (special is not None)
    return totals


def token_counts(
    df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row's whole text.

    ``tokenizer`` is the path of a byte-level BPE vocabulary that every executor
    can open. Neither begin nor end tokens are added; a special token's string
    inside a text is that token. A null text is an empty one: 0 tokens. Rows are
    independent, so ties and repeated rows simply repeat; an empty table gives
    an empty result. Other columns are not read. One pass, no shuffle.
    """
    chosen = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = counted(texts, tokenizer)
            size = pc.binary_length(batch.column(batch.num_columns - 1)).cast("int64")
            columns = [*batch.columns[:-1], size, pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(count, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
