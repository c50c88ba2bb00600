from __future__ import annotations

import pytest

from lexprism import SentimentConfig
from lexprism.operators import validation as H

THREE = SentimentConfig("text", human_label_column="h", positive_label="1", negative_label="0", neutral_label="2")
TWO = SentimentConfig("text", human_label_column="h", positive_label="1", negative_label="0")


def run(spark, rows, config):
    scores = spark.createDataFrame(rows, "h string, compound double")
    table = H.confusion(H.labelled_scores(scores, config), H.classes_of(config))
    metrics = H.class_metrics(table)
    return table, metrics, H.validation_summary(metrics).first()


def test_confusion_metrics_and_balanced_accuracy(spark):
    rows = [("1", 0.5)] * 60 + [("1", 0.0)] * 20 + [("0", -0.5)] * 30 + [("0", 0.9)] * 10 + [("x", 0.5), (None, 0.1), (" 1", 0.2)]
    table, metrics, summary = run(spark, rows, THREE)
    got = {(r["human_label"], r["predicted_label"]): r["documents"] for r in table.collect()}
    assert len(got) == 9
    assert got["positive", "positive"] == 60 and got["positive", "neutral"] == 20
    assert got["negative", "positive"] == 10 and got["neutral", "neutral"] == 0
    m = {r["class"]: r for r in metrics.collect()}
    assert m["positive"]["precision"] == pytest.approx(60 / 70) and m["positive"]["recall"] == pytest.approx(0.75)
    assert m["positive"]["f1"] == pytest.approx(120 / 150) and m["positive"]["support"] == 80
    assert (m["neutral"]["precision"], m["neutral"]["recall"], m["neutral"]["f1"], m["neutral"]["support"]) == (0, 0, 0, 0)
    assert summary["balanced_accuracy"] == pytest.approx((0.75 + 0.75) / 2)
    assert summary["macro_f1"] == pytest.approx((120 / 150 + 60 / 70 + 0) / 3)
    assert (summary["status"], summary["labeled_documents"]) == (H.NOT_SUPPORTED, 120)


def test_two_way_rule_counts_zero_as_positive(spark):
    _, metrics, summary = run(spark, [("1", 0.0)] * 99 + [("0", -0.01)] * 1, TWO)
    assert summary["status"] == H.SUPPORTED and summary["macro_f1"] == 1.0
    assert [r["class"] for r in metrics.collect()] == ["negative", "positive"]


@pytest.mark.parametrize("count,status", [(0, H.NO_LABELS), (99, H.FEW_LABELS), (100, H.SUPPORTED)])
def test_status_by_number_of_labels(spark, count, status):
    table, metrics, summary = run(spark, [("1", 0.5)] * (count // 2) + [("0", -0.5)] * (count - count // 2) + [("other", 0.5)] * 5, TWO)
    assert summary["status"] == status and summary["labeled_documents"] == count
    assert summary["meaning"]
    if not count:
        assert table.count() == 0 and metrics.count() == 0
        assert summary["balanced_accuracy"] is None


def test_wide_form(spark):
    table, _, _ = run(spark, [("1", 0.5)] * 3 + [("0", 0.5)] * 2, TWO)
    rows = [tuple(r) for r in H.confusion_matrix(table, H.classes_of(TWO)).collect()]
    assert rows == [("negative", 0, 2), ("positive", 0, 3)]
