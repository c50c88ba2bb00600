from __future__ import annotations

import numpy as np
import pytest

from lexprism import DataProblem, audit_corpus
from lexprism.operators import audit as A

SCHEMA = "id string, grp string, text string"


def codes(audit):
    return [r["code"] for r in audit.warnings.collect()]


def test_counts_on_a_small_table(spark):
    df = spark.createDataFrame(
        [
            ("A", "one", "write ana@example.org"),
            ("A", "one", "write ana@example.org"),
            ("B", "two", ""),
            ("C", "two", "short note"),
        ],
        SCHEMA,
    )
    audit = audit_corpus(df, "text", "id", "grp")
    row = audit.summary.first()
    assert row["duplicate_unit_rows"] == 2 and row["missing_unit_rows"] == 0
    assert row["exact_duplicate_rows"] == 2 and row["exact_duplicate_sets"] == 1
    assert row["blank_documents"] == 1 and row["blank_rate"] == 0.25
    assert row["documents_with_possible_email"] == 2
    assert row["group_levels"] == 2 and row["minimum_group_documents"] == 1
    assert codes(audit) == [
        "repeated_identifier", "many_blanks", "exact_duplicates", "short_documents", "contact_details", "small_level",
    ]
    assert len(audit.summary.columns) == 18


def test_units_compare_raw_values_and_miss_blank_ones(spark):
    df = spark.createDataFrame([(v, "g", "t") for v in ["x", " x", "x", None, "  ", "y"]], SCHEMA)
    row = A.unit_checks(A.document_profile(df, "text", "id", "grp")).first()
    assert (row["duplicate_unit_rows"], row["missing_unit_rows"]) == (2, 2)


def test_groups_merge_null_and_blank_into_missing(spark):
    df = spark.createDataFrame(
        [("1", " a ", "t"), ("2", "a", ""), ("3", None, "t"), ("4", " ", "t"), ("5", "b", "t")], SCHEMA
    )
    audit = audit_corpus(df, "text", "id", "grp")
    got = {r["group"]: (r["source_rows"], r["nonblank_documents"], r["share_nonblank"]) for r in audit.group_distribution.collect()}
    assert got == {"(missing)": (2, 2, 0.5), "a": (2, 1, 0.25), "b": (1, 1, 0.25)}
    row = audit.summary.first()
    assert (row["group_levels"], row["minimum_group_documents"], row["missing_group_rows"]) == (2, 1, 2)


def test_duplicates_are_case_sensitive(spark):
    df = spark.createDataFrame([("1", "g", "Same text"), ("2", "g", "same text"), ("3", "g", "same  text")], SCHEMA)
    row = A.exact_duplicates(A.document_profile(df, "text")).first()
    assert tuple(row) == (2, 1)


def test_length_points_equal_linear_quantiles(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(1, 90, 57)]
    df = spark.createDataFrame([(str(i), "g", t) for i, t in enumerate(texts)], SCHEMA)
    table = {r["point"]: r for r in audit_corpus(df, "text").length_distribution.collect()}
    lengths = [t.count("word") for t in texts]
    for name, at in A.LENGTH_POINTS.items():
        assert table[name]["words"] == pytest.approx(round(float(np.quantile(lengths, at)), 1), abs=1e-9)
    assert list(table) == list(A.LENGTH_POINTS)


def test_no_group_gives_an_empty_table_and_no_group_warning(spark):
    df = spark.createDataFrame([("1", "g", "many words in this one text here now ok")], SCHEMA)
    audit = audit_corpus(df, "text")
    assert audit.group_distribution.count() == 0
    assert codes(audit) == []
    assert audit.summary.first()["missing_unit_rows"] == 0


def test_single_level_is_warned_about(spark):
    df = spark.createDataFrame([("1", "g", "many words in this one text here now ok")], SCHEMA)
    assert codes(audit_corpus(df, "text", group="grp")) == ["few_levels", "small_level"]


@pytest.mark.parametrize("rows", [[], [("1", "g", "  "), ("2", "g", None)]])
def test_empty_and_blank_tables_are_refused(spark, rows):
    with pytest.raises(DataProblem):
        audit_corpus(spark.createDataFrame(rows, SCHEMA), "text")


def test_missing_columns_and_row_cap_are_refused(spark):
    df = spark.createDataFrame([("1", "g", "t"), ("2", "g", "t")], SCHEMA)
    for bad in ({"text_column": "body"}, {"text_column": "text", "unit": "uid"}, {"text_column": "text", "group": "G"}):
        with pytest.raises(DataProblem):
            audit_corpus(df, **bad)
    with pytest.raises(DataProblem):
        audit_corpus(df, "text", max_rows=1)
