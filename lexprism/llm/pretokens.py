"""Byte-level BPE vocabularies and their pre-tokens, found on whole batches of code points at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from .memo import Memo

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
CODE_POINTS = 0x110000
CHUNK_CHARS = 1 << 20


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file of the kind ``BPE`` with the ``ByteLevel`` pre-tokenizer.

    Files with a normaliser, a prefix space, or special tokens that strip or
    match whole words only follow other rules and are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, splitter = content["model"], content["pre_tokenizer"] or {}
        extras = content["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in extras)
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            model["type"] != "BPE" or content["normalizer"] or model.get("dropout") or model.get("ignore_merges")
            or not plain or {k: splitter.get(k) for k in wanted} != wanted
        ):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.path = path
        self.special = {t["content"]: t["id"] for t in extras}
        self.byte_ids = np.array([ids[c] for c in _byte_characters()], np.int32)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)


_MADE = Memo()


def vocabulary(path: str) -> Vocabulary:
    return _MADE.made(path, lambda: Vocabulary(path))


def _classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, CODE_POINTS)]))
    kinds = np.full(CODE_POINTS, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"), (UNKNOWN, r"\p{Cn}+")):
        for found in regex.finditer(pattern, every):
            kinds[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    return kinds


def _resolved(kinds: np.ndarray, points: np.ndarray, path: str) -> None:
    """Code points newer than the pattern library: ask the tokenizer which class they are in."""
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    for point in np.unique(points).tolist():
        probe = chr(point)
        joins = {kind: len(splitter.pre_tokenize_str(f"{c}{probe}")) == 1 for kind, c in ((LETTER, "a"), (NUMBER, "1"))}
        kinds[point] = next((kind for kind, one in joins.items() if one), OTHER)


def starts(points: np.ndarray, text_starts: np.ndarray, path: str) -> np.ndarray:
    """Positions at which a pre-token begins, in code points of texts laid end to end.

    A pre-token is a contraction ('s 't 're 've 'm 'll 'd), or a run of
    letters, of numbers or of other marks with the single blank before it, or
    white space: all of it but its last character, which stands alone unless it
    is a blank that belongs to what follows.
    """
    kinds = _MADE.made("classes", _classes)
    kind = kinds[points]
    if (kind == UNKNOWN).any():
        _resolved(kinds, points[kind == UNKNOWN], path)
        kind = kinds[points]
    size = len(points)
    fresh = np.zeros(size + 1, bool)
    fresh[text_starts] = True
    fresh[size] = True
    begins = fresh.copy()
    begins[1:size] |= kind[1:] != kind[:-1]

    runs = np.flatnonzero(begins)
    ends = runs[1:]
    runs = runs[:-1]
    white = kind[runs] == SPACE
    after = ends[white]
    after = after[~fresh[after]]  # white space at the end of a text is one pre-token
    begins[after - 1] = True
    begins[after[points[after - 1] == 0x20]] = False

    quotes = np.flatnonzero((points == 0x27) & begins[:size])
    if len(quotes):
        padded = np.append(points, [0, 0])
        inside = ~fresh[np.minimum(quotes + 1, size)]
        first, second = padded[quotes + 1], padded[quotes + 2]
        inside_two = inside & ~fresh[np.minimum(quotes + 2, size)]
        short = inside & np.isin(first, [ord(c) for c in "stmd"])
        long = inside_two & np.isin(first * 256 + second, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        begins[quotes[short | long] + 1] = False
        begins[quotes[short] + 2] = True
        begins[quotes[long] + 3] = True
    return np.flatnonzero(begins[:size])


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about a million characters, with the place of each group's first text."""
    first, held = 0, 0
    for place, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK_CHARS:
            yield first, texts[first : place + 1]
            first, held = place + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def split(texts: list[str], known: Vocabulary) -> tuple[list[str], np.ndarray, list[tuple[int, str | None]]]:
    """Pre-tokens of all texts in order.

    Returns the pre-tokens, the number of them before each segment (and their
    total), and for each segment its text's place and the special token that
    follows it, if any.
    """
    segments, owners = [], []
    for place, text in enumerate(texts):
        pieces = [text]
        marks: list[str] = []
        for special in known.special:
            if special in text:
                pieces, marks = _cut(text, known.special)
                break
        for k, piece in enumerate(pieces):
            segments.append(piece)
            owners.append((place, marks[k] if k < len(marks) else None))
    whole = "".join(segments)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    offsets = np.zeros(len(segments) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if not len(points):
        return [], np.zeros(len(segments) + 1, np.int64), owners
    begins = starts(points, offsets[:-1], known.path)
    ends = np.append(begins[1:], len(points))
    words = [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
    return words, np.searchsorted(begins, offsets), owners


def _cut(text: str, special: dict[str, int]) -> tuple[list[str], list[str]]:
    """A text cut at its special tokens: leftmost first, the longest where several begin together."""
    import re

    found = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return found[0::2], found[1::2]
