from __future__ import annotations

import math
from dataclasses import replace

import pytest

from lexprism import DataProblem, TextConfig
from lexprism.operators import contrast as C
from lexprism.operators import vocabulary as V
from lexprism.operators.documents import keyed_texts, token_table

CONFIG = TextConfig("text", unit="id", group="stage", planned_topics=3)


def prepared(df, config):
    tokens = token_table(keyed_texts(df, config), config)
    vocabulary = V.fit_vocabulary(tokens, config)
    return tokens, vocabulary, V.term_matrix(tokens, vocabulary)


def brute_odds(first, second):
    background = [a + b for a, b in zip(first, second)]
    mass = sum(background) + len(background)
    n1, n2 = sum(first), sum(second)
    out = []
    for y1, y2, bg in zip(first, second, background):
        alpha = 1000.0 * (bg + 1.0) / mass
        delta = math.log((y1 + alpha) / (n1 + 1000.0 - y1 - alpha)) - math.log((y2 + alpha) / (n2 + 1000.0 - y2 - alpha))
        out.append((delta, delta / math.sqrt(1.0 / (y1 + alpha) + 1.0 / (y2 + alpha))))
    return out


def test_log_odds_equal_the_formula(spark):
    first, second = [5, 0, 17, 3], [1, 4, 17, 0]
    rows = [("x", f"t{i}", a, b) for i, (a, b) in enumerate(zip(first, second))]
    df = spark.createDataFrame(rows, "side string, term string, a long, b long")
    got = {r["term"]: (r["log_odds"], r["z_score"]) for r in C.log_odds(df, "a", "b", "side").collect()}
    for i, (delta, z) in enumerate(brute_odds(first, second)):
        assert got[f"t{i}"] == (pytest.approx(delta, abs=1e-12), pytest.approx(z, abs=1e-12))


def test_symmetric_contrast_points_the_right_way(spark, planted):
    config = replace(CONFIG, focal_group="early", reference_group="late")
    tokens, vocabulary, matrix = prepared(planted, config)
    assert C.choose_comparison(tokens, config) == C.Comparison(C.SYMMETRIC, ("early", "late"))
    C.require_supported_groups(tokens, config)
    rows = C.symmetric_contrast(matrix, vocabulary, config).collect()
    assert len(rows) <= 80
    assert [abs(r["z_score"]) for r in rows] == sorted((abs(r["z_score"]) for r in rows), reverse=True)
    side = {r["term"]: r["direction"] for r in rows}
    assert {side.get("soil"), side.get("compost"), side.get("tulip")} <= {"early", None}
    assert {side.get("skillet"), side.get("oven"), side.get("pepper")} <= {"late", None}
    assert set(side.values()) == {"early", "late"}


def test_one_vs_rest_includes_unlabelled_documents_in_the_rest(spark, planted):
    from pyspark.sql import functions as F

    config = replace(CONFIG, group="variant")
    some_blank = planted.withColumn("variant", F.when(F.col("id") < "R0020", " ").otherwise(F.col("variant")))
    tokens, vocabulary, matrix = prepared(some_blank, config)
    chosen = C.choose_comparison(tokens, config)
    assert chosen == C.Comparison(C.ONE_VS_REST, ("blue", "green", "red"))
    rows = C.variant_contrast(matrix, vocabulary, chosen.levels, config).collect()
    counts = dict(zip(vocabulary.terms, vocabulary.counts))
    for variant, word in (("red", "scarlet"), ("green", "emerald"), ("blue", "cobalt")):
        found = [r for r in rows if r["variant"] == variant and r["term"] == word]
        assert len(found) == 1 and found[0]["z_score"] > 0 and found[0]["variant_count"] >= 20
        assert found[0]["comparison"] == f"{variant} vs rest"
    for row in rows:
        assert row["variant_count"] + row["rest_count"] == counts[row["term"]]
    assert all(sum(r["variant"] == v for r in rows) <= 30 for v in chosen.levels)


def test_designs(spark, planted):
    tokens, _, _ = prepared(planted, replace(CONFIG, group=None))
    assert C.choose_comparison(tokens, replace(CONFIG, group=None)).design == C.NO_CONTRAST
    labelled = token_table(keyed_texts(planted, CONFIG), CONFIG)
    assert C.choose_comparison(labelled, CONFIG).design == C.ONE_VS_REST


def test_too_many_levels_and_thin_levels_are_refused(spark, planted):
    from pyspark.sql import functions as F

    number = F.substring("id", 2, 4).cast("int")
    seven = token_table(keyed_texts(planted.withColumn("stage", (number % 7).cast("string")), CONFIG), CONFIG)
    with pytest.raises(DataProblem, match="more than 6"):
        C.choose_comparison(seven, CONFIG)
    thin = planted.withColumn("stage", F.when(number < 12, "few").otherwise("many"))
    tokens = token_table(keyed_texts(thin, CONFIG), CONFIG)
    with pytest.raises(DataProblem, match="20"):
        C.choose_comparison(tokens, CONFIG)
    pair = replace(CONFIG, focal_group="few", reference_group="many")
    C.choose_comparison(tokens, pair)
    with pytest.raises(DataProblem, match="20"):
        C.require_supported_groups(tokens, pair)
