from __future__ import annotations

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexprism import DataProblem, TextConfig, analyze_text
from lexprism.operators import vocabulary as V
from lexprism.operators.documents import keyed_texts, token_table
from lexprism.operators.topics import comparison as N
from lexprism.operators.topics import factorise as X
from lexprism.operators.topics import sampling as S
from lexprism.operators.topics import stability as B
from lexprism.operators.topics import start as Y
from lexprism.operators.topics import tables as P
from lexprism.session import materialise

from conftest import POOLS

CONFIG = TextConfig("text", unit="id", group="variant", planned_topics=3, stability_iterations=3)


@pytest.fixture(scope="module")
def planted_matrix(spark, planted):
    tokens = token_table(keyed_texts(planted, CONFIG), CONFIG)
    vocabulary = V.fit_vocabulary(tokens, CONFIG)
    return vocabulary, materialise(V.term_matrix(tokens, vocabulary), "matrix")


def dense(vocabulary, matrix):
    rows = matrix.filter(F.size("indices") > 0).orderBy("doc_key").collect()
    out = np.zeros((len(rows), len(vocabulary.terms)))
    for i, row in enumerate(rows):
        out[i, row["indices"]] = row["weights"]
    return out


def fit_rows(matrix, partitions=3):
    usable = matrix.filter(F.size("indices") > 0).repartition(partitions)
    return usable.withColumn("member", F.array(F.lit(True))).persist()


# --- samples ---


def test_sample_size_rule():
    assert [S.sample_size(k, n) for k, n in ((2, 1000), (8, 80), (3, 10), (5, 101))] == [800, 64, 10, 81]


@pytest.mark.parametrize("at_once, window", [(10_000, 8.0), (10_000, 0.0), (3, 0.0), (3, 0.2)])
def test_samples_are_exact_seeded_and_independent_of_partitions(spark, monkeypatch, at_once, window):
    """Also where the window misses the boundary and the digits have to find it."""
    monkeypatch.setattr(S, "RANKED_AT_ONCE", at_once)
    monkeypatch.setattr(S, "WINDOW", window)
    fits = [(2, 1), (2, 2), (3, 1)]
    keys = spark.range(1000).select(F.col("id").alias("doc_key"))
    first = {tuple(r) for r in S.sampled_documents(keys.repartition(1), fits, 5).collect()}
    second = {tuple(r) for r in S.sampled_documents(keys.repartition(7), fits, 5).collect()}
    assert first == second
    members = {fit: {d for k, i, d in first if (k, i) == fit} for fit in fits}
    assert all(len(m) == 800 for m in members.values())
    assert members[2, 1] != members[2, 2] != members[3, 1]
    other = {tuple(r) for r in S.sampled_documents(keys, fits, 6).collect()}
    assert other != first


# --- start ---


def test_sample_limits_are_the_ranked_draws(spark):
    for count in (1, 2, 9, 20_000):
        fits, keys = [(2, 1), (3, 2)], spark.range(count).select(F.col("id").alias("doc_key"))
        for k, i in fits:
            drawn = sorted(__import__("hashlib").md5(f"{key}:{k}:{i}:5".encode()).hexdigest() for key in range(count))
            assert S.sample_limits(keys, fits, count, 5)[k, i] == drawn[S.sample_size(k, count) - 1]
    assert S.sample_limits(keys, [], 0, 5) == {}


def test_spectrum_equals_dense_svd(spark, planted_matrix):
    vocabulary, matrix = planted_matrix
    x = dense(vocabulary, matrix)
    rows = fit_rows(matrix)
    spectrum = Y.full_spectrum(rows, x.shape[1], 3, 1)
    _, values, vectors = np.linalg.svd(x, full_matrices=False)
    assert spectrum.values[:3] == pytest.approx(values[:3], rel=1e-3)
    assert np.abs(np.einsum("ij,ji->i", vectors[:3], spectrum.vectors[:, :3])) == pytest.approx(np.ones(3), abs=0.02)
    assert spectrum.square_sum == pytest.approx((x**2).sum())
    assert spectrum.entry_sum == pytest.approx(x.sum())
    start = Y.starting_topics(rows, [spectrum], [3], [-1])[0]
    assert start.shape == (3, x.shape[1]) and (start > 0).all()
    assert start[0] == pytest.approx(np.maximum(np.sqrt(values[0]) * np.abs(vectors[0]), 0), abs=0.05)


# --- factorisation ---


def brute_row(image, gram):
    """Best of all supports of a non-negative least-squares problem."""
    k = len(image)
    best, value = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for support in itertools.combinations(range(k), size):
            part = list(support)
            w = np.linalg.solve(gram[np.ix_(part, part)], image[part])
            if (w >= 0).all():
                loss = -2 * w @ image[part] + w @ gram[np.ix_(part, part)] @ w
                if loss < value - 1e-14:
                    best, value = np.zeros(k), loss
                    best[part] = w
    return best


def test_row_weights_equal_brute_force():
    rng = np.random.default_rng(0)
    h = rng.random((2, 4, 9)) ** 3
    x = rng.random((30, 9)) - 0.2
    images = np.stack([x @ h[f].T for f in range(2)])
    got = X.row_weights(images, h @ h.transpose(0, 2, 1))
    for f in range(2):
        for i in range(30):
            assert got[f, i] == pytest.approx(brute_row(images[f, i], h[f] @ h[f].T), abs=1e-6)


def test_row_weights_allow_an_empty_topic():
    h = np.vstack([np.ones(4), np.zeros(4)])
    got = X.row_weights((np.ones((3, 4)) @ h.T)[None], (h @ h.T)[None])
    assert got[0] == pytest.approx(np.tile([1.0, 0.0], (3, 1)), abs=1e-8)


def dense_fit(x, start, rounds=400):
    h = start.copy()
    for _ in range(rounds):
        w = X.row_weights((x @ h.T)[None], (h @ h.T)[None])[0]
        h = X.improved_topics(h, w.T @ w, w.T @ x)
    w = X.row_weights((x @ h.T)[None], (h @ h.T)[None])[0]
    return h, np.linalg.norm(x - w @ h) / np.linalg.norm(x)


def test_fit_equals_a_dense_solver_and_ignores_partitions(spark, planted_matrix):
    vocabulary, matrix = planted_matrix
    x = dense(vocabulary, matrix)
    fits = []
    for partitions in (1, 7):
        rows = fit_rows(matrix, partitions)
        spectrum = Y.full_spectrum(rows, x.shape[1], 3, 1)
        start = Y.starting_topics(rows, [spectrum], [3], [-1])[0]
        fits.append(X.factorise(rows, [X.Fit(3, 0, -1, start, spectrum.square_sum)])[0])
    h, error = dense_fit(x, start)
    for fit in fits:
        assert fit.converged and fit.relative_error == pytest.approx(error, abs=1e-5)
        cosine = np.einsum("ij,ij->i", B._unit_rows(list(fit.components)), B._unit_rows(list(h)))
        assert cosine == pytest.approx(np.ones(3), abs=1e-3)
    assert fits[0].components == pytest.approx(fits[1].components, abs=1e-7)
    w = X.row_weights((x @ fits[0].components.T)[None], (fits[0].components @ fits[0].components.T)[None])[0]
    assert fits[0].relative_error == pytest.approx(np.linalg.norm(x - w @ fits[0].components) / np.linalg.norm(x), abs=1e-9)


def test_error_of_settled_topics_never_rises():
    rng = np.random.default_rng(4)
    x = rng.random((60, 12)) ** 4
    fit = X.Fit(3, 0, -1, rng.random((3, 12)), float((x**2).sum()))
    errors = []
    for _ in range(60):
        w = X.row_weights((x @ fit.components.T)[None], (fit.components @ fit.components.T)[None])[0]
        fit = X._advance(fit, w.T @ w, w.T @ x)
        errors.append(fit.residual)
        if fit.converged:
            break
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    assert fit.converged and fit.passes < 60


def test_many_partial_sums_are_added_in_two_levels(spark, planted_matrix, monkeypatch):
    from lexprism.operators.topics import passes

    vocabulary, matrix = planted_matrix
    x = dense(vocabulary, matrix)
    monkeypatch.setattr(passes, "SPREAD", 2)
    monkeypatch.setattr(passes, "CHUNK_BYTES", 0)
    monkeypatch.setattr(passes, "PIECE", 50)
    rows = fit_rows(matrix, 5)
    found = passes.accumulate(rows, x.shape[1], [x.shape[1], 1], lambda d, m: [d.sum(axis=0), np.array([float(len(d))])])
    assert found[0] == pytest.approx(x.sum(axis=0)) and found[1][0] == len(x)


def test_chunks_keep_order_and_size(monkeypatch):
    from lexprism.operators.topics import passes

    monkeypatch.setattr(passes, "CHUNK_BYTES", 10)
    assert [range(6)[s] for s in passes.chunks([4, 4, 4, 12, 1, 1])] == [range(0, 2), range(2, 3), range(3, 4), range(4, 6)]


# --- alignment and stability ---


@pytest.mark.parametrize("k", [2, 3, 5, 6])
def test_matching_equals_all_permutations(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        similarity = rng.random((k, k))
        best = max(itertools.permutations(range(k)), key=lambda p: sum(similarity[i, j] for i, j in enumerate(p)))
        assert B.best_matching(similarity) == list(best)


def test_alignment_undoes_a_permutation(spark):
    rng = np.random.default_rng(1)
    reference = rng.random((3, 20))
    shuffled = reference[[2, 0, 1]] * 5
    listed = [(3, 1, t + 1, reference[t].tolist(), shuffled[t].tolist()) for t in (1, 2, 0)]
    schema = "k int, iteration int, topic int, reference array<double>, candidate array<double>"
    pairs = spark.createDataFrame(listed, schema)
    rows = B.align(pairs).collect()
    assert sorted(r["topic"] for r in rows) == [1, 2, 3]
    assert [r["similarity"] for r in rows] == pytest.approx([1.0] * 3)
    summary = B.stability_by_count(B.align(pairs)).first()
    assert (summary["mean_topic_stability"], summary["minimum_topic_stability"]) == pytest.approx((1.0, 1.0))


# --- tables ---


def shares_frame(spark, weights):
    df = spark.createDataFrame([(i, "g", w) for i, w in enumerate(weights)], "doc_key int, label string, topic_weights array<double>")
    return P.document_shares(df)


def test_document_topics_edge_cases(spark):
    shares = shares_frame(spark, [[1.0, 3.0], [2.0, 2.0], [0.0, 0.0]])
    rows = {r["doc_key"]: r for r in P.document_topics(shares, 2, 0.6).collect()}
    assert (rows[0]["topic"], rows[0]["assignment_strength"], rows[0]["ambiguous"]) == ("Topic 2", 0.75, False)
    expected = -(0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(2)
    assert rows[0]["normalized_entropy"] == pytest.approx(expected)
    assert (rows[1]["topic"], rows[1]["ambiguous"]) == ("Topic 1", True)
    assert rows[1]["normalized_entropy"] == pytest.approx(1.0)
    assert (rows[2]["topic"], rows[2]["assignment_strength"], rows[2]["ambiguous"]) == ("Topic 1", 0.0, True)


def test_top_documents_break_ties_by_key_and_limit_before_moving(spark):
    shares = shares_frame(spark, [[1.0, 0.0]] * 6 + [[0.0, 1.0]] * 2)
    top = P.top_documents(shares)
    rows = sorted(tuple(r) for r in top.collect())
    assert [(t, r, d) for t, r, d, _ in rows] == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 6), (2, 2, 7), (2, 3, 0)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


# --- the whole analysis ---


@pytest.fixture(scope="module")
def result(planted):
    return analyze_text(planted, CONFIG)


def test_planted_topics_are_recovered(result):
    found: dict[str, set] = {}
    for row in result.topic_terms.collect():
        found.setdefault(row["topic"], set()).add(row["term"])
    matched = {pool: max(found, key=lambda t: len(set(words) & found[t])) for pool, words in POOLS.items()}
    assert sorted(matched.values()) == ["Topic 1", "Topic 2", "Topic 3"]
    assert all(len(set(POOLS[p]) & found[t]) >= 6 for p, t in matched.items())


def test_planted_topics_are_stable_and_clear(result):
    row = result.diagnostics.first()
    assert row["lexical_coverage"] == 1.0
    assert row["minimum_topic_stability"] > 0.9
    assert row["minimum_topic_prevalence"] > 0.2
    assert row["ambiguous_document_rate"] < 0.1
    assert row["nmf_converged"] and row["nmf_fits_at_iteration_cap"] == 0
    assert row["contrast_prior_mass"] == 1000.0
    assert row["contrast_design"] == "one-vs-rest per variant"
    assert row["comparison_variant_levels"] == ["blue", "green", "red"]


def test_comparison_covers_the_neighbouring_counts(result):
    rows = result.topic_count_comparison.collect()
    assert [r["topics"] for r in rows] == [2, 3, 4, 5]
    assert [r["selected_plan"] for r in rows] == [False, True, False, False]
    errors = [r["relative_reconstruction_error"] for r in rows]
    assert errors == sorted(errors, reverse=True)
    assert all(0 < r["top_term_diversity"] <= 1 for r in rows)


def test_shares_by_variant_sum_to_one(result):
    rows = result.variant_topic_prevalence.collect()
    assert [r["variant"] for r in rows] == ["blue", "green", "red"]
    assert all(sum(r[f"Topic {i}"] for i in (1, 2, 3)) == pytest.approx(1.0) for r in rows)
    prevalence = result.topic_prevalence.collect()
    assert sum(r["mean_weight_share"] for r in prevalence) == pytest.approx(1.0)
    assert sum(r["dominant_documents"] for r in prevalence) == 240
    assert all(len(r["top_terms"].split(", ")) == 6 for r in prevalence)


def test_representatives_and_warnings(result):
    assert [(r["topic"], r["rank"]) for r in result.representatives.collect()] == [
        (f"Topic {t}", r) for t in (1, 2, 3) for r in (1, 2, 3)
    ]
    assert [r["code"] for r in result.warnings.collect()] == [
        "topics_are_patterns", "choices_matter", "masking_is_partial", "english_list", "variant_contrast",
        "variant_prevalence",
    ]
    assert result.group_contrast.count() == 0
    assert result.variant_contrast.count() > 0


def test_same_seed_gives_the_same_topics(spark, planted, result):
    again = analyze_text(planted.repartition(3), CONFIG)
    first = [(r["topic"], r["rank"], r["term"], round(r["weight"], 6)) for r in result.topic_terms.collect()]
    second = [(r["topic"], r["rank"], r["term"], round(r["weight"], 6)) for r in again.topic_terms.collect()]
    assert first == second


def test_small_corpora_and_bad_settings_are_refused(spark, planted):
    with pytest.raises(DataProblem, match="at least 80"):
        analyze_text(planted.limit(40), CONFIG)
    for bad in ({"planned_topics": 9}, {"min_df": 1}, {"max_df": 0.4}, {"ngram_max": 3}, {"max_features": 499},
                {"top_terms": 21}, {"stability_iterations": 51}):
        with pytest.raises(DataProblem):
            analyze_text(planted, replace(CONFIG, group=None, **bad))


def test_compared_counts():
    assert N.compared_counts(3, 500, 500) == [2, 3, 4, 5]
    assert N.compared_counts(7, 500, 500) == [2, 3, 4, 5, 6, 7, 8]
    assert N.compared_counts(3, 500, 4) == [2, 3]
    with pytest.raises(DataProblem):
        N.compared_counts(3, 2, 2)


def test_sample_starts_go_on_until_they_are_steady(spark, planted_matrix):
    vocabulary, matrix = planted_matrix
    terms = len(vocabulary.terms)
    rows = matrix.filter("size(indices) > 0").withColumn("member", F.array(F.lit(True), F.crc32(F.col("doc_key").cast("binary")) % 5 > 0))
    full = Y.full_spectrum(rows, terms, 3, 1)
    samples = Y.sample_spectra(rows, full, [3, 3])
    assert full.steady and all(s.steady and 1 < s.steps < Y.MOST_STEPS for s in samples)
    assert np.allclose(samples[0].values[:3], full.values[:3], rtol=1e-3)


def test_rows_stop_on_their_own():
    draw = np.random.default_rng(2)
    h = draw.random((3, 9))
    x = draw.random((20, 9))
    together, unfinished = X.solved_rows((x @ h.T)[None], (h @ h.T)[None])
    alone = np.vstack([X.row_weights((row[None] @ h.T)[None], (h @ h.T)[None])[0] for row in x])
    assert np.array_equal(together[0], alone) or np.allclose(together[0], alone, rtol=0, atol=1e-12)
    assert not unfinished.any()


def test_the_driver_gets_one_array_however_many_tasks_there_are(spark, monkeypatch):
    from lexprism.operators.topics import passes

    rows = spark.range(64, numPartitions=16).selectExpr("array(cast(id % 5 as int)) indices", "array(1.0D) weights", "array(true) member")
    seen, fetch = [], type(rows).toArrow

    def recorded(df):
        seen.append(fetch(df))
        return seen[-1]

    monkeypatch.setattr(type(rows), "toArrow", recorded)
    wide = 20_000
    found = passes.accumulate(rows, 5, [wide, 5], lambda dense, inside: [np.full(wide, float(len(dense))), dense.sum(axis=0)])
    assert (found[0] == 64).all() and found[1].tolist() == [13.0, 13.0, 13.0, 13.0, 12.0]
    assert sum(table.nbytes for table in seen) < 1.2 * 8 * wide


def test_partial_sums_do_not_grow_with_the_parts_the_rows_were_written_in(spark, planted_matrix):
    from lexprism.operators.topics import passes

    vocabulary, matrix = planted_matrix
    most = max(N.LEAST_PASS_TASKS, N.PASS_TASKS_PER_SLOT * spark.sparkContext.defaultParallelism)
    terms = len(vocabulary.terms)
    sums = []
    for parts in (3, most + 90):
        written = spark.createDataFrame(matrix.rdd.repartition(parts), matrix.schema)
        rows = N._fit_rows(written.filter(F.size("indices") > 0), F.array(F.lit(True)))
        assert rows.rdd.getNumPartitions() == min(parts, most)
        sums.append(passes.accumulate(rows, terms, [terms], lambda dense, inside: [dense.sum(axis=0)])[0])
        rows.unpersist()
    np.testing.assert_allclose(sums[0], dense(vocabulary, matrix).sum(axis=0), rtol=1e-12)
    np.testing.assert_allclose(sums[1], sums[0], rtol=1e-12)
