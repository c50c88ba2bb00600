"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

The words of a batch that were not met before lie in one flat array of symbols.
In each round every word finds its pair of the best score and joins the places
of that pair from the left, all words at once; the array is then compacted, and
words without a pair leave. Joining one place at a time, best score and
leftmost first, gives the same pieces: a word's round ends at the first place
whose new symbol makes a pair that would have been joined before the next.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .pretokens import chunks
from .token_counts import NONE, PairTable

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
KEPT_WORDS = 600_000
LONG_WORD = 1 << 12
BESIDE_BITS = 22
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """A model file of the kind BPE with byte fallback, blanks marked before words and no text normalisation.

    Others follow other rules and are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        content = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            content.ParseFromString(file.read())
        trained, normal = content.trainer_spec, content.normalizer_spec
        kinds = [p.type for p in content.pieces]
        names = [p.piece for p in content.pieces]
        usual = [name for name, kind in zip(names, kinds) if kind == NORMAL]
        if (
            trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix
            or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces
            or not normal.add_dummy_prefix or content.HasField("denormalizer_spec")
            or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usual)
        ):
            raise ValueError(f"{path} is no plain BPE model with byte fallback")
        self.size = len(names)
        self.byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = np.array([kind == BYTE for kind in kinds])
        self.marked = np.array([kind == NORMAL and name.startswith(SPACE) for name, kind in zip(names, kinds)])
        said = [
            b"" if kind == CONTROL else bytes([int(name[1:-1], 16)]) if kind == BYTE
            else (trained.unk_surface if kind == UNKNOWN else name.replace(SPACE, " ")).encode("utf-8")
            for name, kind in zip(names, kinds)
        ]
        self.surface, self.surface_start, self.surface_size = _stretches(said)
        self.digits, self.digits_start, self.digits_size = _stretches([b"%d," % i for i in range(self.size)])
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        joined = [name for name in usual if len(name) > 1]
        inside = sorted(set("".join(joined)))
        self.extra = [c for c in inside if c not in self.ids]  # characters that only occur within longer pieces
        symbols = self.ids | {c: self.size + k for k, c in enumerate(self.extra)}
        self.points = np.zeros(0x110000, np.int32)
        for c in {name for name in symbols if len(name) == 1}:
            self.points[ord(c)] = symbols[c]
        self.beside = np.zeros(1 << BESIDE_BITS, bool)  # neighbours within some piece, by hash; a clash only joins more
        text = np.frombuffer("\n".join(joined).encode("utf-32-le"), np.uint32)
        self.beside[_hashed(text[:-1], text[1:])] = True
        joiners = "".join(map(re.escape, (c for c in inside if c != SPACE)))
        self.cut = re.compile(f"{SPACE}+[{joiners}]*|[{joiners}]+|.", re.DOTALL).findall

        pairs = [
            (-content.pieces[symbols[name]].score, symbols[name], symbols[name[:k]], symbols[name[k:]])
            for name in joined
            for k in range(1, len(name))
            if name[:k] in symbols and name[k:] in symbols
        ]
        pairs.sort()
        worth, merged, left, right = (np.array(column) for column in zip(*pairs))
        self.merged = merged.astype(np.int32)
        self.table = PairTable(SimpleNamespace(left=left, right=right, merged=self.merged))
        steps = np.append(0, np.cumsum(worth[1:] != worth[:-1])).astype(np.int32)
        self.level = np.append(steps, NONE)  # pairs of equal score are of one level

    def spelled(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode("utf-8")]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``merged`` and level of each pair; the last place and NONE for what is no pair."""
        found = np.minimum(self.table.rank(left, right), len(self.level) - 1)
        return found, self.level[found]


def _stretches(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings end to end, where each begins and how long it is."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _hashed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left.astype(np.uint64) << np.uint64(21) | right) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BESIDE_BITS)).astype(np.int64)


_MODELS, _KNOWN = Memo(), Memo()


def piece_model(path: str) -> PieceModel:
    return _MODELS.made(path, lambda: PieceModel(path))


def merged_words(words: Sequence[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of all words end to end, and how many of each; words hold joinable characters only."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int32), lengths
    symbol = model.points[points]
    word = np.repeat(np.arange(len(words)), lengths)
    begins = np.append(True, word[1:] != word[:-1])
    begins[1:] |= ~model.beside[_hashed(points[:-1], points[1:])]  # no piece reaches across: parts merge on their own
    owner = np.cumsum(begins) - 1
    word = word[begins]
    pair = np.full(len(symbol), len(model.level) - 1, np.int32)  # of the pair that begins here
    level = np.full(len(symbol), NONE, np.int32)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    pair[inner], level[inner] = model.pairs(symbol[inner], symbol[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(heads, len(symbol)))
        lowest = np.minimum.reduceat(level, heads)
        live = np.repeat(lowest != NONE, sizes)
        if not live.all():
            done.append((owner[~live], symbol[~live]))
            symbol, owner, pair, level = symbol[live], owner[live], pair[live], level[live]
            sizes, lowest = sizes[lowest != NONE], lowest[lowest != NONE]
            if not len(symbol):
                break
        chosen = level == np.repeat(lowest, sizes)
        places = np.flatnonzero(chosen)
        run_start = chosen.copy()
        run_start[1:] &= ~chosen[:-1]
        begun = np.maximum.accumulate(np.where(run_start, np.arange(len(symbol)), 0))
        places = places[(places - begun[places]) % 2 == 0]  # of places that overlap every other one, from the left
        fresh = model.merged[pair[places]]
        places, fresh = _undisturbed(places, fresh, symbol, owner, level, model)

        symbol[places] = fresh
        stay = np.ones(len(symbol), bool)
        stay[places + 1] = False
        moved = np.cumsum(stay) - 1
        symbol, owner, pair, level, at = symbol[stay], owner[stay], pair[stay], level[stay], moved[places]
        mark = np.zeros(len(symbol), bool)
        mark[at] = True
        mark[at[at > 0] - 1] = True
        touched = np.flatnonzero(mark)
        pair[touched], level[touched] = len(model.level) - 1, NONE
        touched = touched[touched < len(symbol) - 1]
        touched = touched[owner[touched] == owner[touched + 1]]
        pair[touched], level[touched] = model.pairs(symbol[touched], symbol[touched + 1])
    owners, symbols = (np.concatenate(side) for side in zip(*done))
    return symbols[np.argsort(owners, kind="stable")], np.bincount(word[owners], minlength=len(words))


def _undisturbed(places, fresh, symbol, owner, level, model) -> tuple[np.ndarray, np.ndarray]:
    """Each word's places up to the first whose new symbol makes a pair at least as good as the one joined.

    To its left a new symbol meets what earlier places left, to its right what
    is there before later places are joined.
    """
    size, now = len(symbol), level[places]
    before = np.maximum(places - 1, 0)
    left = symbol[before]
    follows = np.append(False, places[1:] == places[:-1] + 2)
    left = np.where(follows, np.append(0, fresh[:-1]), left)
    has_left = (places > 0) & (owner[before] == owner[places])
    after = np.minimum(places + 2, size - 1)
    has_right = (places + 2 < size) & (owner[after] == owner[places])
    better = np.zeros(len(places), bool)
    better[has_left] = model.pairs(left[has_left], fresh[has_left])[1] <= now[has_left]
    better[has_right] |= model.pairs(fresh[has_right], symbol[after[has_right]])[1] <= now[has_right]
    if not better.any():
        return places, fresh
    earlier = np.cumsum(better) - better
    owners = owner[places]
    first = np.append(True, owners[1:] != owners[:-1])
    base = np.maximum.accumulate(np.where(first, earlier, 0))
    kept = earlier == base
    return places[kept], fresh[kept]


class Known:
    """The pieces of words met before: each word's place in one flat array of ids."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str], model: PieceModel) -> None:
        known = [w for w in words if len(w) > 1 or w in model.ids or w in model.extra]
        spelled = [w for w in set(words).difference(known)]  # a character that is in no piece
        symbols, sizes = merged_words(known, model)
        if model.extra and symbols.max(initial=0) >= model.size:  # a character that is no piece of its own
            owner = np.repeat(np.arange(len(known)), sizes)
            alone = [[i] if i < model.size else model.spelled(model.extra[i - model.size]) for i in symbols.tolist()]
            sizes = np.bincount(owner, list(map(len, alone)), minlength=len(known)).astype(np.int64)
            symbols = np.array(list(itertools.chain.from_iterable(alone)), np.int32)
        bytes_of = [model.spelled(w) for w in spelled]
        sizes = np.concatenate([sizes, np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))])
        self.slot.update(zip(itertools.chain(known, spelled), itertools.count(len(self.size))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, symbols, np.array(list(itertools.chain.from_iterable(bytes_of)), np.int32)])


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def encoded(texts: list[str], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece ids of all texts end to end and how many of each, in groups of about a million characters."""
    model = piece_model(path)
    for _, group in chunks(texts):
        known = _KNOWN.made(path, Known)
        if len(known.slot) > KEPT_WORDS:
            known = _KNOWN[path] = Known()
        cut = [model.cut(SPACE + text.replace(" ", SPACE)) if text else [] for text in group]
        words = list(itertools.chain.from_iterable(cut))
        fresh = list(set(words).difference(known.slot))
        known.learn([w for w in fresh if len(w) <= LONG_WORD], model)
        for word in fresh:  # a very long one takes many rounds: not beside thousands of others
            if len(word) > LONG_WORD:
                known.learn([word], model)
        slots = np.fromiter(map(known.slot.__getitem__, words), np.int64, len(words))
        sizes = known.size[slots]
        owner = np.repeat(np.arange(len(group)), np.fromiter(map(len, cut), np.int64, len(cut)))
        counts = np.bincount(owner, sizes, minlength=len(group)).astype(np.int64)
        yield _gathered(known.ids, known.start[slots], sizes), counts


def encode(texts: list[str], path: str) -> list[list[int]]:
    """Piece ids of each text, without begin or end ids; an empty text has none."""
    out: list[list[int]] = []
    for ids, counts in encoded(texts, path):
        ends = np.cumsum(counts).tolist()
        out += [ids[end - count : end].tolist() for end, count in zip(ends, counts.tolist())]
    return out


def decode_bytes(ids: np.ndarray, counts: np.ndarray, model: PieceModel) -> list[bytes]:
    """The texts, in UTF-8, of ids end to end: the blank before the first word goes, byte pieces become characters.

    Control pieces are silent, the unknown piece has the surface the model
    gives it, and each byte that is part of no character becomes U+FFFD.
    """
    flat = _gathered(model.surface, model.surface_start[ids], model.surface_size[ids]).tobytes()
    width = np.append(0, np.cumsum(model.surface_size[ids]))
    ends = np.cumsum(counts)
    begin, end = width[ends - counts].tolist(), width[ends].tolist()
    bytes_before = np.append(0, np.cumsum(model.is_byte[ids]))
    loose = (bytes_before[ends] > bytes_before[ends - counts]).tolist()
    heard = np.flatnonzero(model.surface_size[ids] > 0)  # pieces that say something
    first = np.searchsorted(heard, ends - counts)
    there = first < np.searchsorted(heard, ends)
    lead = np.zeros(len(counts), bool)
    lead[there] = model.marked[ids[heard[first[there]]]]
    silent = width[np.flatnonzero(model.surface_size[ids] == 0)]  # a silent piece parts the bytes beside it
    out = []
    for a, b, broken, mark in zip(begin, end, loose, lead.tolist()):
        text = flat[a + mark : b]
        if broken:
            cuts = [a + mark, *silent[np.searchsorted(silent, a + mark, "right") : np.searchsorted(silent, b)].tolist(), b]
            text = "".join(flat[x:y].decode("utf-8", "each-byte") for x, y in zip(cuts, cuts[1:])).encode("utf-8")
        out.append(text)
    return out


def decode(ids: Sequence[int], path: str) -> str:
    """The text of one list of ids, see ``decode_bytes``."""
    listed = np.asarray(ids, np.int64).reshape(-1)
    return decode_bytes(listed, np.array([len(listed)]), piece_model(path))[0].decode("utf-8")


def piece_ids(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int): the pieces of each row's whole text. One pass, no shuffle.

    ``model_path`` is a SentencePiece model that every executor can open. A null
    text is an empty one and has no ids. Rows are independent, so ties and
    repeated rows repeat; an empty table gives an empty result. Other columns
    are not read; a kept column named ids is refused.
    """

    def listed(texts: list[str]) -> list[pa.Array]:
        return [pa.array(encode(texts, model_path), pa.list_(pa.int32()))]

    return _mapped(df, text, keep, "ids array<int>", listed)


def piece_digests(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text, without moving the ids.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the
    text decoded from those ids. The rest is as for ``piece_ids``.
    """

    def digests(texts: list[str]) -> list[pa.Array]:
        model, tokens, listed, decoded = piece_model(model_path), [], [], []
        for ids, counts in encoded(texts, model_path):
            tokens += counts.tolist()
            told = _gathered(model.digits, model.digits_start[ids], model.digits_size[ids]).tobytes()
            width, ends = np.append(0, np.cumsum(model.digits_size[ids])), np.cumsum(counts)
            places = zip(width[ends - counts].tolist(), width[ends].tolist())
            listed += [hashlib.sha256(told[a : max(a, b - 1)]).hexdigest() for a, b in places]
            decoded += [hashlib.sha256(t).hexdigest() for t in decode_bytes(ids, counts, model)]
        return [pa.array(tokens, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(df, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(df: DataFrame, text: str, keep: tuple[str, ...], added: str, finish) -> DataFrame:
    kept = [F.col(f"`{name}`") for name in keep]
    names = [field.split()[0] for field in added.split(", ")]
    if set(map(str.lower, keep)) & set(names):
        raise ValueError(f"a kept column has the name of a result: {names}")
    chosen = df.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = finish(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*keep, *names])

    return chosen.mapInArrow(convert, f"{schema}, {added}" if schema else added)


def decoded_text(df: DataFrame, model_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with ``name``: the text of each row's piece ids; null ids are an empty list. No shuffle."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decoded(rows):
        return rows.map(lambda row: decode(row.tolist() if row is not None else [], model_path))

    return df.withColumn(name, decoded(F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>"))))
