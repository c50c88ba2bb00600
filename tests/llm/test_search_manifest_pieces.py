"""Ranked search, the Merkle manifest and SentencePiece against plain code, the library and check SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from lexprism.llm import manifest, pieces, ranked_search
from lexprism.llm.queries import ORACLES, QUERIES, tampered_rows
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle_manifest"])
def test_check_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = base.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(map(tuple, found.select(columns).collect()))
    assert rows and rows == sorted(expected.fetchall())


# --- ranked search --------------------------------------------------------


def terms_of(text) -> list[str]:
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded) if w]


def best_by_brute_force(items, docs, k=10):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n, total = len(held), sum(size for *_, size in held)
    df = Counter(t for _, words, _ in held for t in words)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for q, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for i, words, size in held:
            m = 10 + 90 * size * n // total
            s = sum(weight[t] * (10**9 * words[t] // (1000 * words[t] + 8 * m)) for t in terms if t in words)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def drawn_texts(count: int, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    words = ["a", "b", "C", "é", "É", "日", "x1", "it's", "z-z", "\x00q"] + [f"w{k}" for k in range(30)]
    return [
        (draw.choice([None, *range(60)]), draw.choice([None, "", " -- ", *[" ".join(draw.choices(words, k=draw.randrange(1, 40)))] * 5]))
        for _ in range(count)
    ]


@pytest.mark.parametrize("block, first, group", [(1 << 19, 64, 200_000), (300, 2, 200_000), (2000, 8, 60)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block, first, group):
    """Ties, repeated rows, null ids and texts; small blocks carry the bar on, small groups read the texts again."""
    for name, value in (("BLOCK_POSTINGS", block), ("FIRST_READ", first), ("GROUP_TERMS", group)):
        monkeypatch.setattr(ranked_search, name, value)
    items, docs = drawn_texts(25, 1), drawn_texts(400, 2)
    docs += docs[:90]  # repeated rows are ranked each
    docs.append((77, "w1 w2 " * 40_000))  # a very long text
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    rows = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, term string, n int")
    found = ranked_search.ranked_search(asked, rows)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == best_by_brute_force(items, docs)


def test_ranked_search_of_nothing(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    items = rows.withColumnRenamed("doc_id", "item_id")
    assert ranked_search.ranked_search(items, rows.limit(0)).collect() == []
    assert ranked_search.ranked_search(items.limit(0), rows).collect() == []
    assert ranked_search.ranked_search(items, rows.where("doc_id = 2")).collect() == []


def test_reads_stop_early_once_the_bar_is_high():
    """With a high bar from earlier blocks only the front of the lists is read."""
    count = 4000
    place, term = np.tile(np.arange(count), 2), np.repeat([0, 1], count)
    lists = ranked_search.Lists(place, term, np.ones(2 * count, np.int64), np.arange(1, count + 1), np.array([5, 7]), count, count * 2000)
    known = [(10**12, -k) for k in range(10)]

    taken = []
    original = lists.place
    lists.place = type("Front", (), {"__getitem__": lambda self, at: taken.append(len(at)) or original[at]})()
    assert ranked_search.nra(lists, np.array([0, 1]), np.arange(count), 10, known, np.zeros(count, np.int64)) == known
    assert sum(taken) <= 2 * ranked_search.FIRST_READ


def test_length_part_beyond_64_bits():
    assert ranked_search.length_part(np.array([10**9]), 10**11, 10**15).tolist() == [10 + 90 * 10**20 // 10**15]


# --- manifest -------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict, more: int = 0) -> str:
    values = [row[k] if k != "n_chars" or row[k] is None else row[k] + more for k in FIELDS]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest_by_brute_force(rows: list[dict]) -> list[tuple]:
    def grown(level: list[str]) -> list[list[str]]:
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    names = sorted({r["lang"] for r in rows}, key=lambda name: (name is not None, (name or "").encode()))
    held = {n: sorted((r for r in rows if r["lang"] == n), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for n in names}
    trees = {n: grown([leaf_of(r) for r in held[n]]) for n in names}
    top = grown([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(held[name]):
            proof, tampered = "", row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            now = leaf_of(row, int(tampered))
            for levels, at in ((trees[name], i), (top, k)):
                for level in levels[:-1]:
                    beside = level[at ^ 1] if at ^ 1 < len(level) else ""
                    now = digest(beside, now) if at & 1 else digest(now, beside)
                    proof, at = proof + beside, at // 2
            out.append((row["doc_id"], leaf_of(row), trees[name][-1][0], top[-1][0], digest(proof), now, now == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def text_key(row) -> list[str]:
    return [str(v) for v in row]


@pytest.mark.parametrize("levels", [8, 2])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    """Trees of one leaf, of odd sizes and over several bands; null fields, repeated rows and a clashing column."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    draw = random.Random(levels)
    rows = [(k, f"s{k % 3}", "en", k, "text " * (k % 5)) for k in range(301)]
    rows += [
        (draw.choice([None, *range(40)]), draw.choice([None, "s"]), draw.choice([None, "", "a", "é", "日"]), draw.choice([None, 1, 2**63 - 1]), draw.choice([None, "", "x", "日本"]))
        for _ in range(200)
    ]
    rows += [(900, "s", "one", 1, "alone"), (901, "s", "long", 1, "word " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = manifest.dataset_manifest(df.withColumns({"tree": F.lit(1), "digest": F.lit("x"), "lo": F.lit(0)}), tampered=tampered_rows())
    expected = manifest_by_brute_force([dict(zip(FIELDS, r)) for r in rows])
    assert sorted(map(tuple, found.collect()), key=text_key) == sorted(expected, key=text_key)


def test_manifest_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(1, "s", "en", 4, "text")], SCHEMA)
    assert manifest.dataset_manifest(df.limit(0)).collect() == []
    row = manifest.dataset_manifest(df).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == digest("")


def test_every_node_covers_its_children(spark):
    leaves = spark.range(1000).select(F.lit("t").alias("tree"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    forest = manifest.Forest(manifest.ranked(leaves, ["id"]))
    nodes = [r for table in forest.nodes for r in table.collect()]
    assert Counter(r.level for r in nodes) == {k: math.ceil(1000 / 2**k) for k in range(1, 11)}
    assert all(r.lo % 2**r.level == 0 and r.hi == min(r.lo + 2**r.level, 1000) for r in nodes)
    assert [(r.lo, r.hi) for r in forest.roots.collect()] == [(0, 1000)]


# --- sentencepiece --------------------------------------------------------


def odd_texts() -> list[str]:
    draw = random.Random(11)
    kinds = [
        "abcdefghijklmnopqrstuvwxyz  ", "aab ", "▁  ab", "日本語 aé\n1230\x00𝔘\t", "   ", " \n\r\tabc", "éèàñçüß aeiou",
        "{}();=<>/\\\"'.,-_ \n", "the ing er on ",
    ]
    texts = ["", " ", "  ", " " * 100, "▁", "▁▁▁", "a" * 5000, "﻿", "\n" * 50, "=" * 333, "日本" * 100, "<s> </s> <unk> <0x41>", "a ", "\x00"]
    texts += ["".join(draw.choice(kind) for _ in range(draw.randrange(60))) for kind in kinds for _ in range(150)]
    return [*texts, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "".join(draw.choice("abcXYZ019+/") for _ in range(9000))]


def test_encoding_and_decoding_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    ids = pieces.encode(texts, MODEL)
    assert ids == library.encode(texts)
    assert [pieces.decode(i, MODEL) for i in ids] == [library.decode(i) for i in ids]
    draw = random.Random(5)
    for _ in range(3000):  # ids that no text gives: broken characters, control and unknown pieces
        loose = [draw.choice([draw.randrange(32_000), draw.randrange(300), 259, 28705, 1, 264]) for _ in range(draw.randrange(9))]
        assert pieces.decode(loose, MODEL) == library.decode(loose)


def test_piece_tables(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, *odd_texts()[:60], "again", "again"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = pieces.piece_ids(df, MODEL)
    assert {r.doc_id: r.ids for r in rows.collect()} == {k: library.encode(t or "") for k, t in enumerate(texts)}
    back = pieces.decoded_text(rows, MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {k: library.decode(library.encode(t or "")) for k, t in enumerate(texts)}
    for row in pieces.piece_digests(df, MODEL).collect():
        ids = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == digest(",".join(map(str, ids))) and row.decoded_sha256 == digest(library.decode(ids))
    assert pieces.piece_digests(df.limit(0), MODEL).collect() == []
    with pytest.raises(ValueError):
        pieces.piece_digests(df, MODEL, keep=("n_tokens",))


def test_piece_query_over_whole_texts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = QUERIES["op13_piece_ids"](spark, SMALL).collect()
    assert {r.doc_id: r.ids_sha256 for r in found} == {k: digest(",".join(map(str, library.encode(t)))) for k, t in texts.items()}
