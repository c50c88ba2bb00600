"""The word rules of the lexicon score, on the flat word arrays of many documents at once.

Words are split, trimmed, folded and looked up by Arrow; every rule is then a
comparison of arrays shifted by one, two or three words. Only listed words are
scored, so the rules touch a small part of the words.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PART_BYTES = 1 << 20
SUMS = pa.struct([(name, pa.float64()) for name in ("raw", "up", "down", "flat", "emphasis")])


class Words:
    """Words of some documents end to end: as written, folded, and where each document begins."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        token = lists.flatten()
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        bare = pc.utf8_trim(token, characters=PUNCTUATION)
        self.cased = pc.if_else(pc.less_equal(pc.utf8_length(bare), 2), token, bare)
        folded, raised = pc.utf8_lower(self.cased), pc.utf8_upper(self.cased)
        other = np.flatnonzero(~pc.string_is_ascii(self.cased).to_numpy(zero_copy_only=False))
        loud = pc.and_(pc.equal(raised, self.cased), pc.not_equal(folded, self.cased)).to_numpy(zero_copy_only=False)
        if len(other):  # beyond ASCII, one letter can fold to several
            coded = self.cased.take(pa.array(other)).dictionary_encode()
            names = coded.dictionary.to_pylist()
            at = coded.indices.to_numpy()
            mask = np.zeros(len(token), bool)
            mask[other] = True
            folded = pc.replace_with_mask(folded, pa.array(mask), pa.array([w.lower() for w in names], pa.string()).take(coded.indices))
            loud = loud.copy()
            loud[other] = np.array([w.upper() == w and w.lower() != w for w in names])[at]
        self.folded, self.loud = folded, loud
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(token)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)


class Rules:
    """The rule values and word lists, made ready for looking words up."""

    def __init__(self, rules, words: Sequence[str], valences: Sequence[float]):
        self.rules = rules
        self.words, self.valences = list(words), list(valences)
        phrases = dict(rules.phrases) | {}
        self.phrase_words = sorted({w for phrase in [*phrases, *dict(rules.phrase_boosts)] for w in phrase.split(" ")})

    def __reduce__(self):
        return Rules, (self.rules, self.words, self.valences)

    @cached_property
    def listed(self) -> tuple[pa.Array, np.ndarray]:
        return pa.array(self.words, pa.string()), np.append(np.array(self.valences, float), np.nan)

    @cached_property
    def boosts(self) -> tuple[pa.Array, np.ndarray]:
        r = self.rules
        table = {w: -r.booster for w in r.weakening} | {w: r.booster for w in r.strengthening}
        return pa.array(list(table), pa.string()), np.array([*table.values(), 0.0])

    @cached_property
    def negating(self) -> pa.Array:
        return pa.array(list(self.rules.negating), pa.string())

    @cached_property
    def special(self) -> dict[str, int]:
        names = ["no", "or", "nor", "never", "so", "this", "without", "doubt", "kind", "of", "least", "at", "very", self.rules.contrast]
        return {name: i for i, name in enumerate(dict.fromkeys(names))}

    def _coded(self, table) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of two or three words as sorted keys, and their values."""
        code = {w: i + 1 for i, w in enumerate(self.phrase_words)}
        base, keys = len(code) + 1, {}
        for phrase, value in dict(table).items():
            parts = phrase.split(" ")
            if not 2 <= len(parts) <= 3:
                raise ValueError(f"a phrase has two or three words: {phrase!r}")
            parts = [0] * (3 - len(parts)) + [code[w] for w in parts]
            keys[(parts[0] * base + parts[1]) * base + parts[2]] = value
        order = sorted(keys)
        return np.array(order, np.int64), np.array([keys[k] for k in order] + [np.nan])

    @cached_property
    def phrases(self):
        return self._coded(self.rules.phrases)

    @cached_property
    def phrase_boosts(self):
        return self._coded(self.rules.phrase_boosts)

    @cached_property
    def phrase_codes(self) -> pa.Array:
        return pa.array(self.phrase_words, pa.string())


def _places(words: pa.Array, values: pa.Array) -> np.ndarray:
    """Place of each word in ``values``; their number where it is none of them."""
    found = pc.fill_null(pc.index_in(words, value_set=values), len(values))
    return found.to_numpy(zero_copy_only=False)


def _read(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The value of each key; NaN where there is none."""
    known, values = table
    if not len(known):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], np.nan)


def word_scores(words: Words, ready: Rules, valence: np.ndarray) -> np.ndarray:
    """A number for each word; ``valence`` is NaN where a word is not listed."""
    r, count = ready.rules, len(valence)
    keys, by_place = ready.boosts
    boost = by_place[_places(words.folded, keys)]
    negates = (_places(words.folded, ready.negating) < len(ready.negating)) | pc.match_substring(words.folded, "n't").to_numpy(zero_copy_only=False)
    special = _places(words.folded, pa.array(list(ready.special), pa.string()))
    louds = np.bincount(words.owner, words.loud, minlength=len(words.sizes))
    mixed = ((louds > 0) & (louds < words.sizes))[words.owner]
    unlisted = np.isnan(valence)

    at = np.flatnonzero(~unlisted & (boost == 0))  # the words that are scored
    behind = words.sizes[words.owner[at]] - 1 - words.place[at]  # words of the document that follow

    def there(offset: int) -> np.ndarray:
        return words.place[at] >= -offset if offset < 0 else behind >= offset

    def near(values: np.ndarray, offset: int) -> np.ndarray:
        return values[np.clip(at + offset, 0, count - 1)]

    def said(offset: int, *names: str) -> np.ndarray:
        found = near(special, offset)
        return there(offset) & np.logical_or.reduce([found == ready.special[name] for name in names])

    kept = ~(said(0, "kind") & said(1, "of"))
    start = valence[at]
    after_no = said(-1, "no") | said(-2, "no") | (said(-3, "no") & said(-1, "or", "nor"))
    alone = said(0, "no") & there(1) & ~near(unlisted, 1)
    value = np.where(after_no, start * r.negation, np.where(alone, 0.0, start))
    value = value + np.where(words.loud[at] & mixed[at], np.where(value < 0, -r.capitals, r.capitals), 0.0)

    for back in (1, 2, 3):
        counts = there(-back) & near(unlisted, -back)
        sign = np.where(value < 0, -1.0, 1.0)
        lifted = near(boost, -back)
        loud = near(words.loud, -back) & mixed[at]
        lift = np.where(lifted != 0, lifted * sign + np.where(loud, r.capitals * sign, 0.0), 0.0)
        factor = np.where(near(negates, -back), r.negation, 1.0)
        if back > 1:
            emphatic = said(-back, "never") & said(1 - back, "so", "this")
            sure = said(-back, "without") & said(1 - back, "doubt")
            if back == 3:
                emphatic |= said(-1, "so", "this")
                sure = said(-3, "without") & (said(-2, "doubt") | said(-1, "doubt"))
            factor = np.where(emphatic, r.never_so, np.where(sure, 1.0, factor))
        moved = (value + lift * r.distance_scale[back - 1]) * factor
        if back == 3 and ready.phrase_words:
            moved = _with_phrases(moved, words, ready, at, behind)
        value = np.where(counts, moved, value)

    least = said(-1, "least") & near(unlisted, -1) & ~said(-2, "at", "very")
    value = np.where(least, value * r.negation, value)
    scores = np.zeros(count)
    scores[at] = np.where(kept, value, 0.0)

    turns = np.flatnonzero(special == ready.special[r.contrast])
    if len(turns):  # weaken what comes before the first contrasting word, strengthen what follows
        first = np.full(len(words.sizes), -1, np.int64)
        owners, firsts = np.unique(words.owner[turns], return_index=True)
        first[owners] = words.place[turns[firsts]]
        turn = first[words.owner]
        scores *= np.where(turn < 0, 1.0, np.where(words.place < turn, r.before_but, np.where(words.place > turn, r.after_but, 1.0)))
    return scores


def _with_phrases(value: np.ndarray, words: Words, ready: Rules, at: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """A phrase of two or three words around a listed word has a value of its own; one before it may shift the value.

    Phrases that end at or before the word come first, of those the first of
    the five windows; one that begins at the word goes over them.
    """
    found = _places(words.folded, ready.phrase_codes)
    code = np.where(found < len(ready.phrase_words), found + 1, -1)
    base = len(ready.phrase_words) + 1

    def window(*offsets: int) -> np.ndarray:
        parts = [code[np.clip(at + o, 0, len(code) - 1)] for o in offsets]
        known = np.logical_and.reduce([p > 0 for p in parts]) & (behind >= offsets[-1])
        parts = [np.zeros(len(at), np.int64)] * (3 - len(parts)) + parts
        return np.where(known, (parts[0] * base + parts[1]) * base + parts[2], -1)

    own = np.full(len(at), np.nan)
    for offsets in ((-1, 0), (-2, -1, 0), (-2, -1), (-3, -2, -1), (-3, -2)):
        own = np.where(np.isnan(own), _read(ready.phrases, window(*offsets)), own)
    for offsets in ((0, 1), (0, 1, 2)):
        ahead = _read(ready.phrases, window(*offsets))
        own = np.where(np.isnan(ahead), own, ahead)
    value = np.where(np.isnan(own), value, own)
    for offsets in ((-3, -2, -1), (-3, -2), (-2, -1)):
        value = value + np.nan_to_num(_read(ready.phrase_boosts, window(*offsets)), nan=0.0)
    return value


def emphasis(texts: pa.Array, rules) -> np.ndarray:
    shouts = pc.count_substring(texts, "!").to_numpy(zero_copy_only=False)
    marks = pc.count_substring(texts, "?").to_numpy(zero_copy_only=False)
    asked = np.where(marks > 3, rules.question_cap, np.where(marks > 1, marks * rules.question, 0.0))
    return np.minimum(shouts, rules.exclamation_cap) * rules.exclamation + asked


def _part(texts: pa.Array, valences: pa.Array | None, ready: Rules) -> pa.Array:
    words = Words(texts)
    if valences is None:
        keys, values = ready.listed
        valence = values[_places(words.folded, keys)]
    else:
        valence = valences.flatten().to_numpy(zero_copy_only=False).astype(float)
    scores = word_scores(words, ready, valence)

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.owner, values, minlength=len(texts))

    columns = [
        summed(scores), summed(np.where(scores > 0, scores + 1.0, 0.0)), summed(np.where(scores < 0, 1.0 - scores, 0.0)),
        summed((scores == 0).astype(float)), emphasis(texts, ready.rules),
    ]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(SUMS))


def score_sums(texts: pa.Array, valences: pa.Array | None, ready: Rules) -> pa.Array:
    """raw, up, down, flat and emphasis of each text; worked off in parts of about a megabyte."""
    begin = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64).cumsum()
    parts, first = [], 0
    texts = pc.fill_null(texts, "")
    while first < len(texts):
        done = begin[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(begin, done + PART_BYTES, "right")))
        some = None if valences is None else valences.slice(first, last - first)
        parts.append(_part(texts.slice(first, last - first), some, ready))
        first = last
    return pa.concat_arrays(parts) if parts else pa.array([], SUMS)
