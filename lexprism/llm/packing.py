"""Bounded-space online packing of token ids into windows of fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .memo import Memo
from .pretokens import _byte_characters, chunks, split, vocabulary

KEPT_WORDS = 500_000
MERGED = 1 << 62
GROUPED_PARTITIONS = 8
_MODELS, _KNOWN = Memo(), Memo()


def _model(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).model


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer's own model encodes each different pre-token once; texts are
    laid together from these.
    """
    known, model, out = vocabulary(path), _MODELS.made(path, lambda: _model(path)), []
    seen = _KNOWN.made(path, dict)
    shown = dict(enumerate(_byte_characters()))
    special = {name: np.array([i], "<u4").tobytes() for name, i in known.special.items()}
    for _, group in chunks(texts):
        words, before, owners = split(group, known)
        if len(seen) > KEPT_WORDS:
            seen.clear()
        for word in set(words).difference(seen):
            tokens = model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(shown))
            seen[word] = np.array([t.id for t in tokens], "<u4").tobytes()
        found = list(map(seen.__getitem__, words))
        pieces: list[list[bytes]] = [[] for _ in group]
        for k, (place, mark) in enumerate(owners):
            pieces[place] += found[before[k] : before[k + 1]]
            if mark is not None:
                pieces[place].append(special[mark])
        out += [b"".join(p) for p in pieces]
    return out


class OpenWindows:
    """At most ``most`` windows that still take pieces, ordered by the room left in them."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, piece: tuple, length: int) -> list | None:
        """Best fit; where none fits and all are open, the fullest makes way. Returns a window to emit, if any."""
        out = None
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, name = self.room.pop(at)
            self.held[name].append(piece)
        else:
            if len(self.room) == self.most:
                out = self.held.pop(self.room.pop(0)[1])
            room, name = self.size, self.opened
            self.opened += 1
            self.held[name] = [piece]
        if room > length:
            insort(self.room, (room - length, name))
            return out
        full = self.held.pop(name)
        return full if out is None else out + [None] + full

    def leftovers(self) -> list[list]:
        return [self.held[name] for _, name in self.room]


def merged_leftovers(lengths: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, first id, count, window) of pieces in as few windows as hold them.

    Longest first into the best fit; a piece that fits nowhere is cut over the
    windows with most room.
    """
    windows = -(-int(lengths.sum()) // size)
    room = sorted((size, k) for k in range(windows))
    out = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            at = bisect_left(room, (left, -1))
            space, window = room.pop(at if at < len(room) else -1)
            count = min(left, space)
            out.append((piece, start, count, window))
            if space > count:
                insort(room, (space - count, window))
            start, left = start + count, left - count
    return out


COLUMNS = "start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"


def pack(
    df: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str | Column = "text",
    size: int = 2048,
    end_id: int = 1,
    open_windows: int = 64,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: where it lies in its document and in which sequence.

    A document is its ids followed by ``end_id``. Whole windows of a long
    document are sequences of their own; the rest goes to the open window of its
    partition that it fills best, and where none has room the fullest open
    window is emitted. Windows still open at the end of a partition are merged
    over groups of eight partitions, and only there a short piece may be cut.

    Columns: the id column, ``start`` (ids of the document before the piece),
    ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence,
    ``ids_crc32`` of the ids as little-endian unsigned 32-bit numbers, and with
    ``with_ids`` those ids themselves (``ids`` binary).

    Null or empty texts hold the end id alone. Repeated rows and repeated or
    null ids are packed row by row. An empty table gives no pieces. Other
    columns are not read. Documents are never gathered: the only rows that move
    are the leftovers, at most ``open_windows`` windows for each partition.
    """
    text = F.col(text) if isinstance(text, str) else text
    chosen = df.select(F.col(id_column), F.coalesce(text.cast("string"), F.lit("")).alias("__text"))
    key = f"`{id_column}` {chosen.schema[id_column].dataType.simpleString()}"
    end = np.array([end_id], "<u4").tobytes()

    def rows_of(window: list, sequence: int, out: list[list], leftover: int | None) -> None:
        offset = 0
        for piece in window:
            doc, start, total, ids = piece
            length = len(ids) // 4
            kept = ids if with_ids or leftover is not None else None
            row = (doc, start, length, total, sequence, offset, zlib.crc32(ids), kept, leftover)
            for column, value in zip(out, row):
                column.append(value)
            offset += length

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        partition = task.partitionId() if task else 0
        windows, sequence, kind = OpenWindows(size, open_windows), partition << 32, None
        names = [id_column, *(c.split()[0] for c in COLUMNS.split(", ")), "group"]
        types = [pa.int64()] * 6 + [pa.binary(), pa.int64()]

        def flushed(out: list[list]) -> pa.RecordBatch:
            columns = [pa.array(out[0], kind), *(pa.array(c, t) for c, t in zip(out[1:], types))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.field(0).type
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, group in chunks(texts):
                out: list[list] = [[] for _ in names]
                for doc, ids in zip(docs[first:], encoded(group, tokenizer)):
                    ids += end
                    total = len(ids) // 4
                    whole = total // size * size
                    for start in range(0, whole, size):
                        rows_of([(doc, start, total, ids[4 * start : 4 * (start + size)])], sequence, out, None)
                        sequence += 1
                    if whole < total:
                        emitted = windows.place((doc, whole, total, ids[4 * whole :]), total - whole)
                        while emitted:
                            cut = emitted.index(None) if None in emitted else len(emitted)
                            rows_of(emitted[:cut], sequence, out, None)
                            sequence += 1
                            emitted = emitted[cut + 1 :]
                yield flushed(out)
        if kind is not None:
            out = [[] for _ in names]
            for window in windows.leftovers():
                rows_of(window, -1, out, partition // GROUPED_PARTITIONS)
            yield flushed(out)

    def last_pass(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([id_column, "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        placed = merged_leftovers(rows["length"].to_numpy(), size)
        out = rows.iloc[[p for p, *_ in placed]].reset_index(drop=True)
        ids = [rows["ids"].iat[p][4 * a : 4 * (a + n)] for p, a, n, _ in placed]
        out["start"] += [a for _, a, _, _ in placed]
        out["length"] = [n for _, _, n, _ in placed]
        out["sequence_id"] = [MERGED + (int(rows["group"].iat[0]) << 32) + w for *_, w in placed]
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        out["ids_crc32"] = [zlib.crc32(piece) for piece in ids]
        out["ids"] = ids if with_ids else None
        return out.drop(columns="group")

    first = materialise(chosen.mapInArrow(first_pass, f"{key}, {COLUMNS}, group long"), "pieces")
    left = first.where("group is not null").groupBy("group").applyInPandas(last_pass, f"{key}, {COLUMNS}")
    found = first.where("group is null").drop("group").unionByName(left)
    return found if with_ids else found.drop("ids")
