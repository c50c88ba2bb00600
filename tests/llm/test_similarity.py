"""Exact search, SimHash components and sketches against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from lexprism.llm.components import components
from lexprism.llm.exact_search import top_k
from lexprism.llm.simhash import deduplicated, fingerprint, forest, near_duplicates, near_links
from lexprism.llm.sketches import containment, fingerprint_edits, merged_sketch, resemblance, sketch_text, with_sketch
from pyspark.sql import functions as F


def groups_of(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- exact search ---------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    draw = random.Random(2)
    rows = [(k, [draw.choice([0.0, draw.uniform(-1, 1)]) for _ in range(8)], "x") for k in range(700)]
    rows += [(701, [0.5] * 8, "x"), (702, [0.5] * 8, "x"), (703, [0.5] * 8, "x"), (700, [0.5] * 8, "x"), (700, [0.5] * 8, "x")]
    rows += [(704, None, "x"), (705, [float("nan")] * 8, "x"), (706, [None, 1.0], "x"), (707, [float("inf")], "x"), (None, [1.0] * 8, "x"),
             (708, [], "x"), (800, [0.25, 0.5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    found = sorted(map(tuple, top_k(df.where("vec_id % 100 = 0"), df).select("query_id", "rank", "vec_id", "score").collect()))
    usable = [(k, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for k, v, _ in rows
              if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for query, q in {(k, tuple(v)) for k, v in usable if k % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), k) for k, v in usable if k != query)
        expected += [(query, rank, k, -s) for rank, (s, k) in enumerate(scored[:10], 1)]
    assert found == sorted(expected)


def test_top_k_with_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


# --- components and SimHash -----------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(5)
    chain = [(k, k + 1) for k in range(300)]
    star = [(10_000, 1000 + k) for k in range(400)]
    ties = [(draw.randint(2000, 2200), draw.randint(2000, 2200)) for _ in range(150)]
    links = chain + star + ties + chain[:5] + [(9, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = groups_of({n for link in links for n in link}, links)
    assert found == {n: r for n, r in expected.items() if n in found}
    assert all(n in found or expected[n] == n for n in expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def copies(seed: int = 8) -> list[tuple]:
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(40):
        base = draw.choices(words, k=draw.randint(3, 300))
        for _ in range(draw.choice([1, 1, 2, 6])):
            other = list(base)
            if draw.random() < 0.7:
                other[draw.randrange(len(other))] = draw.choice(words)
            rows.append((at, " ".join(other), 0, "x"))
            at += 1
    rows += [(900, None, 0, "x"), (901, "", 0, "x"), (902, " \n ", 0, "x"), (903, "One Two", 0, "x"), (904, "one\ttwo", 0, "x"),
             (904, "one\ttwo", 0, "x"), (905, "ÉTÉ one", 0, "x"), (None, "one two", 0, "x"), (None, "alone here", 0, "x")]
    return rows


def test_fingerprint_by_definition():
    for _, text, *_ in copies():
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("reach", [4, 7])
def test_near_duplicates_equal_brute_force(spark, reach):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, print int, component_id string").repartition(4)
    found = near_duplicates(df, reach=reach).collect()
    prints = [plain_fingerprint(text) for _, text, *_ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= reach]
    roots = groups_of(range(len(rows)), links)
    least = {}
    for k, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[roots[k]] = min(doc, least.get(roots[k], doc))
    expected = sorted(((doc is None, doc or 0, prints[k], least.get(roots[k], -1)) for k, (doc, *_) in enumerate(rows)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.print % 2**64, -1 if r.component_id is None else r.component_id) for r in found)
    assert got == expected


def test_links_in_a_dense_ball_and_beyond_one_block(spark):
    """All fingerprints within one bit of a centre: thousands of pairs, few links, one component."""
    draw = random.Random(1)
    centre = draw.getrandbits(64)
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    far = {draw.getrandbits(64) for _ in range(2000)}
    signed = [(n - 2**64 if n >= 2**63 else n,) for n in near | far]
    links = near_links(spark.createDataFrame(signed, "print long"))
    held = components(links).groupBy("root").count().collect()
    assert [r["count"] for r in held if r["count"] > 100] == [len(near)]
    assert links.count() < 40 * len(near)


def test_forest_joins_what_links_join():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 30, np.uint64)
    a = np.concatenate([base ^ np.uint64(1 << k) for k in range(5)])
    b = np.concatenate([base, draw.integers(0, 2**63, 50, np.uint64)])
    child, root = forest(a, b, 2)
    names = np.concatenate([a, b]).view(np.int64).tolist()
    links = [(int(x), int(y)) for x in a for y in b if (int(x) ^ int(y)).bit_count() <= 2]
    signed = [tuple(v - 2**64 if v >= 2**63 else v for v in pair) for pair in links]
    assert groups_of(names, zip(child.tolist(), root.tolist())) == groups_of(names, signed)


def test_deduplicated_keeps_one_row_of_each_component(spark):
    df = spark.createDataFrame(copies(), "doc_id long, text string, print int, component_id string")
    kept = deduplicated(df)
    assert kept.columns == df.columns
    numbered = df.select(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", F.monotonically_increasing_id().alias("n")).alias("n"), "text")
    rows = near_duplicates(numbered, "n").select("component_id").distinct().collect()
    assert kept.count() == len(rows)
    key = lambda v: (v is None, v)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((r.component_id.doc_id for r in rows), key=key)
    assert deduplicated(df.limit(0)).count() == 0


def test_deduplicated_rows_of_one_id_and_without(spark):
    words = [" ".join(f"{name}{k}" for k in range(60)) for name in ("a", "b", "c")]
    rows = [(1, words[0]), (1, words[1]), (2, words[1]), (None, words[2]), (None, words[2]), (None, None), (7, ""), (3, words[0])]
    kept = deduplicated(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, words[0]), (1, words[1]), (None, words[2]), (7, "")], key=str)
    assert kept.columns == ["doc_id", "text", "key"]


# --- sketches -------------------------------------------------------------


def test_edits_and_neighbours(spark):
    texts = ["", "short", None, "one two three four five six", "été " * 40, "a\U0001f642b\U0001f642c", "long " + "many words here " * 300, "same", "same"]
    rows = [(5 * k, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(3)
    found = {r.doc_id: r for r in fingerprint_edits(df).collect()}
    assert set(found) == {5 * k for k in range(len(texts))}
    for k, text in enumerate(texts):
        text, after = text or "", texts[(k + 1) % len(texts)] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        row = found[5 * k]
        assert (row.n_chars, row.edited_text) == (len(text), edited)
    assert found[35].sketch == found[40].sketch and found[0].sketch == []


def test_repeated_null_and_lone_ids(spark):
    rows = [(1, "b b"), (1, "b b"), (1, "c"), (None, "first text"), (2, "d")]
    found = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_chars) for r in found.collect()) == [(0, 10), (1, 1), (1, 3), (1, 3), (2, 1)]
    lone = fingerprint_edits(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).first()
    assert lone.edited_text == "abcdefab" and lone.next_sketch == lone.sketch
    assert fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_and_merges(spark):
    draw = random.Random(9)
    words = [f"u{k}" for k in range(5000)]
    a, b = draw.choices(words, k=3000), draw.choices(words, k=600)
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:1500] + b), " ".join(a[:300]))], "a string, b string, c string")
    for name in "abc":
        df = with_sketch(df, name, f"s{name}")
    df = with_sketch(df.withColumn("ac", F.concat_ws(" ", "a", "c")), "ac", "sac")

    def shingles(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sa, sb = shingles(a), shingles(a[:1500] + b)
    row = df.select(
        resemblance(F.col("sa"), F.col("sb")).alias("r"), containment(F.col("sc"), F.col("sa")).alias("c"),
        F.size(F.array_except("sa", "sac")).alias("lost"), merged_sketch(F.col("sa"), F.col("sc")).alias("m"), "sa", "sc",
        sketch_text(F.col("sa")).alias("t"),
    ).first()
    assert abs(row.r - len(sa & sb) / len(sa | sb)) < 0.05 and row.c == 1.0 and row.lost == 0
    assert row.m == sorted(set(row.sa) | set(row.sc)) and len(row.t) == 16 * len(row.sa)
    assert abs(len(row.sa) - len(sa) / 4) < 120


def test_sketch_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    plan = fingerprint_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
