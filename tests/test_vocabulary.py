from __future__ import annotations

import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexprism import DataProblem, TextConfig
from lexprism.operators import vocabulary as V
from lexprism.operators.documents import keyed_texts, token_table

CONFIG = TextConfig("text", unit="id", planned_topics=2, min_df=2, max_df=0.9)


def brute_force(documents: list[list[str]], config: TextConfig):
    """Counts, idf and weights straight from the definitions."""
    grams = []
    for words in documents:
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] if config.ngram_max == 2 else []
        grams.append(Counter(words + pairs))
    cf, df = Counter(), Counter()
    for bag in grams:
        cf.update(bag)
        df.update(bag.keys())
    kept = [t for t in cf if config.min_df <= df[t] <= config.max_df * len(documents)]
    kept = sorted(sorted(kept, key=lambda t: (-cf[t], t))[: config.max_features])
    idf = {t: math.log((1 + len(documents)) / (1 + df[t])) + 1 for t in kept}
    weights = []
    for bag in grams:
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        weights.append({t: w / norm for t, w in raw.items()})
    return kept, cf, df, idf, weights


def fitted(spark, documents, config):
    rows = [(f"{i:05d}", " ".join(words)) for i, words in enumerate(documents)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(5)
    tokens = token_table(keyed_texts(df, config), config)
    vocabulary = V.fit_vocabulary(tokens, config)
    return tokens, vocabulary, V.term_matrix(tokens, vocabulary)


def random_documents(seed, count=150, words=900):
    rng = np.random.default_rng(seed)
    odds = 1.0 / np.arange(1, words + 1)
    odds /= odds.sum()
    return [[f"w{i:04d}x" for i in rng.choice(words, size=rng.integers(1, 60), p=odds)] for _ in range(count)]


@pytest.mark.parametrize("ngrams,features", [(1, 10_000), (2, 10_000), (2, 500), (2, 620)])
def test_vocabulary_and_weights_equal_brute_force(spark, ngrams, features):
    config = replace(CONFIG, ngram_max=ngrams, max_features=features, use_english_stopwords=False)
    documents = random_documents(features + ngrams)
    kept, cf, df, idf, weights = brute_force(documents, config)
    _, vocabulary, matrix = fitted(spark, documents, config)
    assert list(vocabulary.terms) == kept
    assert list(vocabulary.counts) == [cf[t] for t in kept]
    assert list(vocabulary.frequencies) == [df[t] for t in kept]
    assert vocabulary.idf == pytest.approx([idf[t] for t in kept], abs=1e-12)
    for row in matrix.collect():
        got = {vocabulary.terms[i]: w for i, w in zip(row["indices"], row["weights"])}
        assert got == pytest.approx(weights[int(row["doc_key"])], abs=1e-12)


def test_pair_join_beyond_the_broadcast_limit_gives_the_same(spark, monkeypatch):
    config = replace(CONFIG, ngram_max=2, max_features=500, use_english_stopwords=False)
    documents = random_documents(11)
    _, first, _ = fitted(spark, documents, config)
    monkeypatch.setattr(V, "BROADCAST_TERM_LIMIT", 0)
    _, second, _ = fitted(spark, documents, config)
    assert first == second


def test_table_counts_empty_documents_in_the_mean(spark):
    documents = [["alpha", "beta"], ["alpha", "beta"], ["gamma", "delta"], ["alpha"], ["rare"], ["single"]]
    config = replace(CONFIG, use_english_stopwords=False, ngram_max=1)
    _, vocabulary, matrix = fitted(spark, documents, config)
    assert vocabulary.terms == ("alpha", "beta")
    table = {r["term"]: r["mean_tfidf"] for r in V.vocabulary_table(matrix, vocabulary).collect()}
    _, _, _, _, weights = brute_force(documents, config)
    for term in vocabulary.terms:
        assert table[term] == pytest.approx(sum(w.get(term, 0.0) for w in weights) / len(documents), abs=1e-12)
    row = V.coverage(matrix).first()
    assert (row["nonblank_documents"], row["usable_documents"]) == (6, 3)
    stats = V.matrix_statistics(matrix, 2).first()
    assert (stats["documents"], stats["entries"]) == (3, 5)
    assert stats["frobenius_norm"] == pytest.approx(math.sqrt(3))
    assert stats["sparsity"] == pytest.approx(1 - 5 / 6)


def test_blank_rows_and_stopwords(spark):
    df = spark.createDataFrame(
        [("1", "The cat and THE dog"), ("2", None), ("3", "  "), ("4", "the")], "id string, text string"
    )
    got = {r["doc_key"]: r["tokens"] for r in token_table(keyed_texts(df, CONFIG), CONFIG).collect()}
    assert got == {"1": ["cat", "dog"], "4": []}


def test_guardrails_flag_each_rule(spark):
    documents = random_documents(5, count=90)
    _, vocabulary, matrix = fitted(spark, documents, replace(CONFIG, ngram_max=1, use_english_stopwords=False))
    row = V.guardrails(matrix, len(vocabulary.terms), replace(CONFIG, planned_topics=5)).first()
    assert (row["nonblank_documents"], row["enough_documents"], row["enough_terms"]) == (90, False, True)


def test_no_surviving_term_is_refused(spark):
    with pytest.raises(DataProblem):
        fitted(spark, [["one"], ["two"], ["three"]], CONFIG)
    with pytest.raises(DataProblem):
        fitted(spark, [["one"]], CONFIG)


def test_repeated_unit_gets_an_assigned_key(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "y z"), (None, "z")], "id string, text string")
    keys = [r["doc_key"] for r in keyed_texts(df, CONFIG).select("doc_key").collect()]
    assert len(set(keys)) == 3 and all(isinstance(k, int) for k in keys)


def test_document_counts_need_no_shuffle(spark):
    documents = random_documents(2, count=30)
    config = replace(CONFIG, use_english_stopwords=False)
    tokens, vocabulary, _ = fitted(spark, documents, config)
    flat = tokens.withColumn("tokens", F.col("tokens")).coalesce(1)
    plan = V.matrix_entries(V.term_matrix(flat, vocabulary), "doc_key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == tokens._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_are_counted_some_documents_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "COUNTED_AT_ONCE", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([["a", "b"], None, ["a", None, "a"], [], ["c"] * 9, ["d"]])], names=["tokens"])
    pieces = [(terms.to_pylist(), owner.tolist()) for terms, owner in V._pieces(iter([batch]))]
    assert pieces == [(["a", "b", "a", "a"], [0, 0, 2, 2]), (["c"] * 9, [0] * 9), (["d"], [0])]


def test_pair_totals_equal_a_plain_count_by_either_way(spark, monkeypatch):
    from collections import Counter

    rows = [(["a", "b", "a", "b", "é"],), (["b", "a"],), ([],), (["a", "x", "b", "é", "b", "é"],), (["a", "b"],)]
    tokens = spark.createDataFrame(rows, "tokens array<string>").repartition(3)
    frequent = spark.createDataFrame([("a",), ("b",), ("é",)], "term string")
    found = [[f"{x} {y}" for x, y in zip(words, words[1:]) if "x" not in (x, y)] for words, in rows]
    counts, frequencies = Counter(p for d in found for p in d), Counter(p for d in found for p in set(d))
    expected = sorted((p, n, frequencies[p]) for p, n in counts.items())
    assert sorted(map(tuple, V.pair_totals(tokens, frequent, 3).collect())) == expected
    monkeypatch.setattr(V, "BROADCAST_TERM_LIMIT", 2)
    assert sorted(map(tuple, V.pair_totals(tokens, frequent, 3).collect())) == expected
    monkeypatch.undo()
    plan = V.pair_totals(tokens, frequent, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each occurrence
