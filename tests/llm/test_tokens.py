"""Token counts and packing against the tokenizer library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from lexprism.llm.packing import OpenWindows, merged_leftovers, pack
from lexprism.llm.token_counts import counted, token_counts
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "a", "  a", "\n\nab", "a\n b", "don't 'sx ''s \n's it'll we'RE're 've", "<|endoftext|>",
    "a<|endoftext|>b<|endoftext|><|endoftext|> c", "͸x ᲀ \U00011de0\U00011de0 a", "a" * 60, "x" * 3000,
    "  \t x\x85y　z 12½ ٣ a_b", "日本語" * 50, " " * 500 + "a", "é‍\U0001f642",
]


def random_texts(count: int, seed: int = 3) -> list[str]:
    draw = random.Random(seed)
    letters = "ab 's'tre\n\t1½é漢\U0001f642!-_  \x1c‍"
    mixed = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 40))) for _ in range(count)]
    wide = ["".join(chr(draw.choice([draw.randint(1, 0x2FF), draw.randint(0x300, 0xD7FF), draw.randint(0xE000, 0x1FFFF)]))
                    for _ in range(30)) for _ in range(count)]
    return mixed + wide


def library_ids(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library():
    texts = ODD + random_texts(400)
    assert counted(texts, PATH).tolist() == [len(library_ids(t)) for t in texts]


def test_token_counts_on_odd_rows(spark):
    rows = [(k, t, 9) for k, t in enumerate(ODD)] + [(None, None, 9), (3, "  a", 9), (3, "  a", 9), (5, "word " * 600, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = token_counts(df, PATH).collect()
    expected = sorted((d is None, d or 0, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 512) for d, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected
    assert token_counts(df.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        counted(["a"], public_tokenizers.path("word_bpe_49k.json"))


def test_open_windows_take_the_best_fit_and_emit_the_fullest():
    windows = OpenWindows(10, 2)
    assert windows.place("a", 6) is None and windows.place("b", 7) is None
    assert windows.place("c", 3) == ["b", "c"]  # the gap of 3 fits better than that of 4
    assert windows.place("d", 5) is None
    assert windows.place("e", 7) == ["a"]
    assert sorted(map(tuple, windows.leftovers())) == [("d",), ("e",)]


def test_merged_leftovers_fill_as_few_windows_as_hold_them():
    draw = np.random.default_rng(1)
    for _ in range(50):
        lengths = draw.integers(1, 2049, draw.integers(1, 40))
        placed = merged_leftovers(lengths, 2048)
        held = np.zeros(-(-lengths.sum() // 2048), int)
        taken = np.zeros(len(lengths), int)
        for piece, start, count, window in placed:
            assert start == taken[piece]
            taken[piece] += count
            held[window] += count
        assert (taken == lengths).all() and held.max() <= 2048


@pytest.mark.parametrize("with_ids", [True, False])
def test_pack_round_trip(spark, with_ids):
    draw = random.Random(4)
    texts = ["".join(draw.choice(["lorem ", "ipsum ", "dolor\n", "été "]) for _ in range(draw.randint(0, 900))) for _ in range(300)]
    texts += ODD + ["word " * 30_000, None, "a" * 2047, "same", "same"]
    rows = [(k if k != 7 else None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(5)
    found = pack(df, PATH, open_windows=4, with_ids=with_ids).toPandas()
    found["doc_id"] = found["doc_id"].fillna(7)
    ids = {float(k): [*library_ids(t), 1] for k, t in enumerate(texts)}
    assert set(found["doc_id"]) == set(ids)
    for doc, pieces in found.sort_values("start").groupby("doc_id"):
        assert pieces["start"].tolist() == [0, *pieces["length"].cumsum()[:-1]]
        assert pieces["length"].sum() == len(ids[doc]) == pieces["doc_tokens"].iat[0]
    for piece in found.itertuples():
        data = np.array(ids[piece.doc_id][piece.start : piece.start + piece.length], "<u4").tobytes()
        assert piece.ids_crc32 == zlib.crc32(data)
        assert not with_ids or bytes(piece.ids) == data
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    used = ordered.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.85


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
