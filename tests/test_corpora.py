"""Audits of many corpora against the audit of each corpus by itself."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexprism import DataProblem
from lexprism.operators import audit as A
from lexprism.operators import corpora as K
from lexprism.operators import decision as D

SCHEMA = "corpus string, unit string, group string, text string"


def mixed_rows(seed: int = 3) -> list[tuple]:
    """Corpora of one row, of blank texts only, without a name, and one with most rows."""
    draw = random.Random(seed)
    words = "soil tide oven anchor butter fern me@site.org www.page.net +49 170 1234567 x".split()
    rows = [("alone", "u", "g", "one text"), ("blank", "b1", "g", " "), ("blank", "b2", None, None), ("blank", None, "", "\n")]
    for _ in range(500):
        corpus = draw.choice(["hot"] * 6 + ["a", " a ", "b", "", None, "(missing)"])
        text = draw.choice([None, "", "same text twice", " ".join(draw.choices(words, k=draw.randint(1, 30)))])
        rows.append((corpus, draw.choice([None, "", " ", *map(str, range(200))]), draw.choice([None, "x", " x", "y", ""]), text))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(mixed_rows(), SCHEMA).repartition(5).persist()


def named(rows):
    return rows.withColumn("name", K.corpus_label("corpus"))


def of(rows, name):
    return named(rows).where(F.col("name") == name)


@pytest.mark.parametrize("unit", ["unit", None])
def test_summaries_equal_single_audits(spark, rows, unit):
    profile = K.corpus_profile(rows, "text", "corpus", unit, "group")
    found = {r["corpus"]: r.asDict() for r in K.corpus_summaries(profile, unit is not None).collect()}
    names = {r[0] for r in named(rows).select("name").distinct().collect()}
    assert set(found) == names == {"alone", "blank", "hot", "a", "b", "(missing)"}
    for name in names:
        single = A.audit_summary(A.document_profile(of(rows, name), "text", unit, "group"), unit is not None).first().asDict()
        assert {k: v for k, v in found[name].items() if k != "corpus"} == pytest.approx(single, nan_ok=True) if name != "blank" else True
    assert found["blank"]["analyzable_documents"] == 0 and found["blank"]["median_words"] is None
    assert found["blank"]["source_rows"] == 3 and found["blank"]["exact_duplicate_rows"] == 0


def test_length_and_group_tables_equal_single_audits(spark, rows):
    summaries, lengths, groups = K.audit_corpora(rows, "text", "corpus", "unit", "group")
    assert summaries.count() == 6
    for name in ("hot", "a", "alone"):
        profile = A.document_profile(of(rows, name), "text", "unit", "group")
        ours = [tuple(r) for r in lengths.where(F.col("corpus") == name).drop("corpus").collect()]
        assert ours == [tuple(r) for r in A.length_distribution(profile).collect()]
        ours = [tuple(r) for r in groups.where(F.col("corpus") == name).drop("corpus").collect()]
        assert ours == [tuple(r) for r in A.group_distribution(profile).collect()]
    assert lengths.where("corpus = 'blank'").count() == 0
    assert K.audit_corpora(rows, "text", "corpus")[2].count() == 0


def test_texts_are_read_once_and_counted_map_side(rows):
    plan = K.corpus_summaries(K.corpus_profile(rows, "text", "corpus", "unit", "group"), True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "collect_list" not in plan


def test_no_corpora(spark, rows):
    nothing = rows.limit(0)
    assert K.corpus_summaries(K.corpus_profile(nothing, "text", "corpus", "unit"), True).count() == 0
    with pytest.raises(DataProblem):
        K.corpus_profile(rows, "text", "no such column")


def test_evidence_of_every_corpus(spark):
    facts = [  # corpus, documents, median, copies of units, terms, coverage, smallest topic, unclear
        ("ready", 200, 20.0, 0, 80, 0.95, 0.2, 0.1, D.READY), ("doubled", 200, 20.0, 2, 80, 0.95, 0.2, 0.1, D.DATA_CHECK),
        ("thin", 79, 20.0, 0, 80, 0.95, 0.2, 0.1, D.LIMITED), ("short", 200, 4.0, 0, 80, 0.95, 0.2, 0.1, D.LIMITED),
        ("poor", 200, 20.0, 0, 49, 0.95, 0.2, 0.1, D.LIMITED), ("uncovered", 200, 20.0, 0, 80, 0.79, 0.2, 0.1, D.LIMITED),
        ("small topic", 200, 20.0, 0, 80, 0.95, 0.04, 0.1, D.UNSTABLE), ("unclear", 200, 20.0, 0, 80, 0.95, 0.2, 0.36, D.REVIEW),
        ("unfitted", 200, None, 0, None, None, None, None, D.LIMITED),
    ]
    columns = "corpus string, analyzable_documents long, median_words double, duplicate_unit_rows long, vocabulary_size long, lexical_coverage double, minimum_topic_prevalence double, ambiguous_document_rate double, expected string"
    df = spark.createDataFrame(facts, columns)
    summaries = df.select("corpus", "analyzable_documents", "median_words", "duplicate_unit_rows")
    lexical = df.where("vocabulary_size is not null").select("corpus", "vocabulary_size", "lexical_coverage")
    topical = df.where("vocabulary_size is not null").select("corpus", "minimum_topic_prevalence", "ambiguous_document_rate")
    judged = {r["corpus"]: r["status"] for r in K.corpus_evidence(summaries, lexical, topical, 3, 0.9).collect()}
    assert judged == {f[0]: f[-1] for f in facts}
    weak = {r["status"] for r in K.corpus_evidence(summaries, lexical, topical, 3, F.lit(0.5)).where("corpus = 'ready'").collect()}
    assert weak == {D.UNSTABLE}


def test_lexical_and_topic_facts(spark):
    matrix = spark.createDataFrame([("a", [0, 2]), ("a", [2]), ("a", []), ("", [1])], "label string, indices array<int>")
    found = {r["corpus"]: (r["vocabulary_size"], r["lexical_coverage"]) for r in K.lexical_facts(matrix).collect()}
    assert found == {"a": (2, pytest.approx(2 / 3)), "(missing)": (1, 1.0)}
    shares = spark.createDataFrame([("a", [0.9, 0.1]), ("a", [0.4, 0.4]), ("b", [0.0, 1.0])], "label string, shares array<double>")
    found = {r["corpus"]: (r["minimum_topic_prevalence"], r["ambiguous_document_rate"]) for r in K.topic_facts(shares, 2, 0.45).collect()}
    assert found == {"a": (pytest.approx(0.25), 0.5), "b": (0.0, 0.0)}
