"""Operators against plain versions of a few lines: quality, language, sketches, links, the draw of sources, components."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from lexprism.llm import mixing, quality, secrets
from lexprism.llm import language as L
from lexprism.llm.sketches import containment, fingerprint_edits, resemblance
from pyspark.sql import functions as F

WRAP = 2**64


def odd_texts() -> list:
    draw = random.Random(9)
    words = "river Stone 42 7 !! ?! (x) été the the the ende\tzwei\nzeilen A1b2 日本".split(" ")
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(60)]
    return [*texts, None, "", " \n", "a", "the the", "long " * 60_000 + "end", texts[0], texts[0]]


# --- quality --------------------------------------------------------------


def plain_features(text) -> dict[int, float]:
    """Words are runs of one kind of byte; words, pairs of words and one more for equal pairs."""
    kind = quality._KIND.tolist()
    mix, place_mix = quality._BYTE_MIX.tolist(), quality._PLACE_MIX.tolist()
    runs: list[list[int]] = []
    data = (text or "").encode()
    for k, byte in enumerate(data):
        if k and kind[byte] == kind[data[k - 1]]:
            runs[-1].append(byte)
        else:
            runs.append([byte])
    words = []
    for run in runs:
        if kind[run[0]] != quality._SPACE:
            h = sum(mix[b] * place_mix[k & 63] for k, b in enumerate(run)) % WRAP
            words.append(h ^ (h >> 29))
    pair, spread = int(quality._PAIR), int(quality._SPREAD)
    grams = words + [(a * pair + b) % WRAP for a, b in zip(words, words[1:])] + [pair for a, b in zip(words, words[1:]) if a == b]
    counts = Counter((g * spread % WRAP) >> (64 - quality.BUCKET_BITS) for g in grams)
    values = {b: 1 + math.log(n) for b, n in counts.items()}
    length = math.sqrt(sum(v * v for v in values.values()))
    return {b: v / length for b, v in values.items()}


def plain_ftrl(rows: list[tuple[int, dict]], rules) -> tuple[dict, float]:
    z, n, constant, constant_n = Counter(), Counter(), 0.0, 0.0

    def weight(b: int) -> float:
        if abs(z[b]) <= rules.l1:
            return 0.0
        return -math.copysign(abs(z[b]) - rules.l1, z[b]) / ((rules.beta + math.sqrt(n[b])) / rules.alpha + rules.l2)

    for _ in range(rules.passes):
        for label, values in rows:
            w = {b: weight(b) for b in values}
            p = 1 / (1 + math.exp(-(constant + sum(w[b] * v for b, v in values.items()))))
            for b, v in values.items():
                g = (p - label) * v
                z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / rules.alpha * w[b]
                n[b] += g * g
            constant_n += (p - label) ** 2
            constant -= rules.alpha / (rules.beta + math.sqrt(constant_n)) * (p - label)
    return {b: weight(b) for b in z}, constant


def test_quality_equals_a_plain_loop(spark):
    texts = odd_texts()
    for text in texts:
        buckets, values = quality.features(text)
        expected = plain_features(text)
        assert dict(zip(buckets.tolist(), values.tolist())) == pytest.approx(expected, abs=1e-6)
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in ids], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    learned = [r[0] for r in docs.where(~quality.in_fold("doc_id", 5, 0)).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))).collect()]
    weights, constant = plain_ftrl([(i % 3 % 2, plain_features(texts[i])) for i in learned], quality.FtrlRules())
    assert model.constant == pytest.approx(constant, abs=1e-4)
    for row in quality.score_quality(docs, model).collect():
        margin = constant + sum(weights.get(b, 0.0) * v for b, v in plain_features(texts[row.doc_id]).items())
        assert row.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-4)


def test_texts_of_one_id_count_once(spark):
    """An id that many documents have gives one example, whatever the order of the rows."""
    rows = [(1, f"many texts {k}") for k in range(300)] + [(k, "good words here") for k in range(2, 40)] + [(k, "%% ## %%") for k in range(40, 80)]
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(1, 80)], "doc_id long, quality int")
    first = quality.train_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = quality.train_quality(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), labels)
    least = min(spark.createDataFrame([r for r in rows if r[0] == 1], "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect(), key=lambda r: r.h)
    alone = quality.train_quality(spark.createDataFrame([(1, least.text), *rows[300:]], "doc_id long, text string"), labels)
    assert first.constant == again.constant == alone.constant and (first.weights == alone.weights).all()


def test_pipeline_stages_with_clashing_columns(spark):
    import corpus_pipeline

    words = "river stone bridge garden window morning letter answer winter summer people story".split()
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choices(words, k=40)), "en", f"s{k % 3}", 200, k, "x", "y", 1.0, "z") for k in range(60)]
    rows += [(60, None, None, None, None, 1, "x", "y", 1.0, "z"), (61, "", "en", "s0", 0, 1, "x", "y", 1.0, "z"), rows[0]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, row string, key string, score double, mix_copy string"
    df = spark.createDataFrame(rows, kinds)
    kept = corpus_pipeline.near_copies(spark, df, "")
    assert kept.dtypes == df.dtypes and kept.count() <= 61
    hidden = corpus_pipeline.secrets(spark, kept, "")
    drawn = corpus_pipeline.mixing(spark, hidden, "")
    assert drawn.dtypes == df.dtypes and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in corpus_pipeline.packing(spark, drawn, "").collect()} == {r.doc_id for r in drawn.collect()}


# --- language -------------------------------------------------------------


def plain_language(text, dictionaries) -> str:
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    words = " ".join(re.sub(r"[\W\d_]+", " ", text.lower()).split()).encode()
    found = {}
    for name, content in dictionaries.items():
        total = 0
        for k in range(0, len(words), 2000):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made = zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False, write_dict_id=False)
            total += len(made.compress(words[k : k + 2000]))
        found[name] = total
    return min(sorted(found), key=found.get)


def test_language_equals_plain_compression(spark):
    texts = [*odd_texts(), "der fluss und die brücke am morgen", "the river and the bridge in the morning", "123 !!"]
    content = {
        "de": ("der fluss und die brücke am morgen ist still " * 50).encode(), "en": ("the river and the bridge in the morning is quiet " * 50).encode(),
        "zz": ("the river and the bridge in the morning is quiet " * 50).encode(),  # as en: a tie goes to the first in the alphabet
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in L.predict_languages(df, content).collect()}
    assert found == {i: plain_language(t, content) for i, t in enumerate(texts)}
    assert "zz" not in found.values() and {"de", "en", "und"} <= set(found.values())


def test_the_most_learnable_language_never_vanishes(spark, monkeypatch):
    """A share far below one in a million still lets the smallest hashes through."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("die brücke am fluss").alias("text"), F.lit("de").alias("lang"))
    assert set(L.train_languages(df, sample_documents=2)) == {"de"}
    share = 600 / 10**10
    kept = spark.range(10).select(L.within_share(F.lit(-(2**63)) + F.col("id"), F.lit(share)).alias("kept"))
    assert all(r.kept for r in kept.collect())
    beyond = spark.range(1).select(L.within_share(F.lit(0).cast("long"), F.lit(share)).alias("kept"), L.within_share(F.lit(2**63 - 1), F.lit(1.0)).alias("all"))
    assert tuple(beyond.first()) == (False, True)


# --- sketches -------------------------------------------------------------


def plain_sketch(text: str) -> list[int]:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]

    def chained(parts: list[str]) -> int:
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part.encode(), seed)
        return seed - WRAP if seed >= 2**63 else seed

    hashes = [chained(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [chained([" ".join(words)])] if words else []
    below = sorted({h for h in hashes if h < -(2**63) + 2**62})
    return below or sorted(hashes)[:1]


def test_sketches_equal_plain_hashes(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprint_edits(df).select(
        "*", resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("within"),
    ).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text, after = texts[row.doc_id] or "", texts[(row.doc_id + 1) % len(texts)] or ""
        quarter = len(text) // 4
        own, edited, following = plain_sketch(text), plain_sketch(text[: len(text) - quarter] + after[:quarter]), plain_sketch(after)
        assert (row.sketch, row.edited_sketch, row.next_sketch) == (own, edited, following)
        for found, other in ((row.near, edited), (row.next, following)):
            together = set(own) | set(other)
            assert found == pytest.approx(len(set(own) & set(other)) / len(together) if together else 1.0)
        assert row.within == pytest.approx(len(set(own) & set(edited)) / len(own) if own else 1.0)


# --- secrets --------------------------------------------------------------


def plain_links(text: str) -> list[tuple]:
    """Every pair of parts of one scope, looked at one by one."""
    base = secrets.base_findings(text)
    meets = lambda a, others: any(o[0] < a[1] and a[0] < o[1] for o in others)
    scopes = [m.start() for m in secrets.SCOPE_END.finditer(text)]
    edges = list(zip([0, *scopes], [*scopes, len(text)]))
    scope = lambda a: max(k for k, (begin, _) in enumerate(edges) if begin <= a[0])
    shares = lambda a, o: o[0] < edges[scope(a)][1] and o[1] > edges[scope(a)][0]
    covered = [f[:2] for f in base]
    names = [m.span() for m in secrets.IDENTIFIER.finditer(text)]
    places = [m.span() for m in secrets.ENDPOINT.finditer(text)]
    opaque = [s for s in (m.span() for m in secrets.OPAQUE.finditer(text)) if not meets(s, names)]
    weak = {s for s in [*opaque, *(m.span() for m in secrets.SHORT_SECRET.finditer(text))] if not meets(s, covered) and not meets(s, places)}
    names = [s for s in names if not meets(s, covered)]
    ids = [f[:2] for f in base if f[2] == "access"]
    linked = [s for s in weak if any(shares(s, o) for o in names + places + ids)]
    strong = [f[:2] for f in base if f[2] != "access"]
    out = [(s, "linked_secret") for s in linked]
    out += [(s, "linked_id") for s in names if any(shares(s, o) for o in linked + strong)]
    out += [(s, "linked_endpoint") for s in places if any(shares(s, o) for o in linked + strong)]
    return sorted(out)


def test_links_equal_a_nested_loop(spark):
    draw = random.Random(6)
    parts = [
        "user=anna", "client_id: web-7", "login = bob@site", "pwd=hunter22", "auth: Xy12345!", "https://db.site.org/x?y=1", "ftp://files",
        "aB3dE5gH7jK9mN1pQ3rS5", "password=correcthorse12", "AKIA" + "Q" * 16, "0123456789abcdef01", "plain words here", "AWS_SECRET_ACCESS_KEY=aB3dE5gH7jK9mN1pQ3rS5tU7",
        "DB_USER=admin", "x", "token: abc", "été",
    ]
    texts = ["", None]
    for _ in range(400):
        said = draw.choices(parts, k=draw.randint(1, 12))
        texts.append("".join(p + draw.choice([" ", "\n", ", ", "\n\n", "\n \t\n", "; "]) for p in said))
    texts.append("user=anna " + "words " * 50_000 + "pwd=hunter22")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = 0
    for row in secrets.scan_secrets(df).collect():
        found = sorted(((f.start, f.end), f.kind) for f in row.findings if f.kind.startswith("linked"))
        assert found == plain_links(texts[row.doc_id] or ""), texts[row.doc_id][:300]
        linked += len(found)
    assert linked > 500


# --- the draw of sources --------------------------------------------------


def plain_draw(rows: list[tuple], budget: dict, seed: int, blocks: dict, hashed: dict, places: dict) -> Counter:
    """Whole passes, then blocks in their order, then documents in theirs, while the tokens before are below the budget."""
    out = Counter()
    for source, goal in budget.items():
        own = [(places[source, hashed[doc] % blocks[source]], hashed[doc], doc, n) for doc, s, n in rows if s == source]
        total = sum(n for *_, n in own)
        for *_, doc, _ in own:
            out[doc] += goal // total
        spent = 0
        for *_, doc, n in sorted(own):
            if spent < goal % total:
                out[doc] += 1
            spent += n
    return +out


@pytest.mark.parametrize("few", [True, False])
def test_draw_equals_a_plain_one(spark, monkeypatch, few):
    """Also where the sources are too many for the driver: the same weights, documents and copies."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10_000 if few else 1)
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 7)
    draw = random.Random(2)
    rows = [(k, draw.choice(["hot"] * 6 + ["a", "b", "c"]), draw.randint(1, 60)) for k in range(400)] + [(1000, "lone", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    found = mixing.mix_sources(df, tokens=F.col("n"), target_entropy=None, toward_even=0.5, most_repeats=4.0).collect()
    totals = Counter()
    for _, source, n in rows:
        totals[source] += n
    shares = {s: t / sum(totals.values()) for s, t in totals.items()}
    names = sorted(totals)
    own = mixing.entropy([shares[s] for s in names]) / math.log(len(names))
    exponent = mixing.exponent_for([shares[s] for s in names], own + 0.5 * (1 - own), 4.0)
    weights = dict(zip(names, mixing.tempered([shares[s] for s in names], exponent)))
    assert exponent < 1 and all(abs(r.mix_weight - weights[r.source]) < 1e-9 for r in found)
    largest = max(totals, key=totals.get)
    budget = {s: max(totals[s], round(totals[largest] / weights[largest] * weights[s])) for s in names} | {largest: totals[largest]}
    blocks = {s: -(-sum(1 for r in rows if r[1] == s) // 7) for s in names}
    hashed = {r[0]: r.h for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).alias("h")).collect()}
    keys = spark.createDataFrame([(s, b) for s in names for b in range(blocks[s])], "named string, mix_block long")
    places = {(r.named, r.mix_block): r.p for r in keys.select("*", mixing._block_place(17).alias("p")).collect()}
    assert Counter(r.doc_id for r in found) == plain_draw(rows, budget, 17, blocks, hashed, places)
    assert any(r.mix_copy > 0 for r in found) and any(budget[s] % totals[s] for s in names)


def test_exponent_over_a_table_equals_the_bisection(spark):
    draw = random.Random(8)
    totals = [draw.randint(1, 10**9) for _ in range(50)]
    shares = [t / sum(totals) for t in totals]
    sized = spark.createDataFrame([(t,) for t in totals], "total long")
    for target, repeats in ((0.9, None), (0.9, 2.0), (None, 3.0), (None, None), (0.1, None)):
        assert mixing.exponent_on_table(sized, target, repeats) == pytest.approx(mixing.exponent_for(shares, target, repeats), abs=1e-9)
    assert mixing.exponent_on_table(sized.limit(0), 0.9, 2.0) == 1.0


# --- similarity at scale --------------------------------------------------


def test_random_fingerprints_meet_few_others(spark):
    """Below one pair in a hundred shares a cell; the grid of every near pair holds it."""
    from lexprism.llm import simhash

    prints = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64))
    near = prints[:500] ^ (np.uint64(1) << np.random.default_rng(2).integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << np.random.default_rng(3).integers(0, 64, 500).astype(np.uint64))
    df = spark.createDataFrame([(int(p),) for p in np.unique(np.concatenate([prints, near])).view(np.int64)], "print long")
    cells = df.select("print", F.explode(simhash.cell_keys(F.col("print"), 4)).alias("cell"))
    met = cells.groupBy("cell").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    count = df.count()
    assert met < 0.01 * count * (count - 1) / 2
    links = {frozenset((r.a, r.b)) for r in simhash.near_links(df, 4).collect()}
    assert all(frozenset((int(a), int(b))) in links for a, b in zip(prints[:500].view(np.int64), near.view(np.int64)) if a != b)


def test_rising_chains_take_few_rounds(spark, monkeypatch):
    from lexprism.llm import components as C

    rounds = []
    original = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: rounds.append(name) or original(df, name))
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in C.components(links).collect()} == {(k, 0) for k in range(301)}
    assert rounds.count("links") - 1 <= 12
