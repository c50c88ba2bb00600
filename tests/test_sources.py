from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexprism import DataProblem
from lexprism.config import check_contract
from lexprism.sources import readers as R
from lexprism.sources import writers as W

ROWS = [(1, "first response"), (2, 'second, "quoted"\nresponse')]


def as_rows(df):
    return sorted((int(r["document_id"]), r["text"]) for r in df.collect())


def test_csv_json_and_parquet_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('document_id,text\n1,first response\n2,"second, ""quoted""\nresponse"\n')
    records = [{"document_id": i, "text": t} for i, t in ROWS]
    (tmp_path / "a.json").write_text("﻿ " + json.dumps(records), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"note": "x", "data": records}, indent=1))
    spark.createDataFrame(ROWS, "document_id long, text string").write.parquet(str(tmp_path / "c.parquet"))
    for name in ("a.csv", "a.json", "b.json", "c.parquet"):
        assert as_rows(R.read_table(spark, str(tmp_path / name))) == ROWS, name


def test_declared_schemas(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"document_id": 1, "text": "t", "more": 2}]}))
    (tmp_path / "a.csv").write_text("document_id,text\n1,t\n")
    for reader, name in ((R.read_json, "a.json"), (R.read_csv, "a.csv")):
        df = reader(spark, str(tmp_path / name), schema="document_id string, text string")
        assert [tuple(r) for r in df.collect()] == [("1", "t")]


def test_csv_missing_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,text,n\na,NA,1\nb,n/a,\nc,None,3\nd,kept,4\n")
    df = R.read_csv(spark, str(tmp_path / "a.csv"))
    assert [r["text"] for r in df.orderBy("name").collect()] == [None, None, None, "kept"]
    plain = R.read_csv(spark, str(tmp_path / "a.csv"), na_values=())
    assert [r["text"] for r in plain.orderBy("name").collect()] == ["NA", "n/a", "None", "kept"]


@pytest.mark.parametrize("content", ['{"rows": [{"a": 1}]}', '{"data": 3}', '{"data": [1, 2]}', '"text"'])
def test_other_json_shapes_are_refused(spark, tmp_path, content):
    (tmp_path / "a.json").write_text(content)
    with pytest.raises(DataProblem):
        R.read_json(spark, str(tmp_path / "a.json"))


def test_lines_are_numbered_in_file_order_across_splits(spark, tmp_path):
    lines = [f"  line {i} é " if i % 7 else "   " for i in range(3000)]
    (tmp_path / "a.txt").write_text("﻿" + "\r\n".join(lines[:10]) + "\n" + "\n".join(lines[10:]), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = R.read_lines(spark, str(tmp_path / "a.txt"))
        assert df.rdd.getNumPartitions() > 3
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [line.strip() for line in lines if line.strip()]
    assert got == [(f"TXT-{i:06d}", text) for i, text in enumerate(kept, start=1)]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc\n")
    row = R.file_fingerprints(spark, str(tmp_path / "a.txt")).first()
    assert tuple(row) == ("a.txt", hashlib.sha256(b"abc\n").hexdigest())
    df = spark.createDataFrame(ROWS * 3 + [(None, None)], "a long, b string")
    first = R.content_fingerprint(df).first()
    assert first == R.content_fingerprint(df.repartition(5).orderBy("b")).first()
    assert first != R.content_fingerprint(df.limit(6)).first()
    assert first["rows"] == 7


def test_shape_rules(spark):
    df = spark.createDataFrame([(1, 2)], " a long, b long")
    assert R.checked_shape(df.toDF(" a ", "A")).columns == ["a", "A"]
    for names in (("a", " a"), ("a", "  ")):
        with pytest.raises(DataProblem):
            R.checked_shape(df.toDF(*names))
    with pytest.raises(DataProblem):
        R.checked_shape(df.limit(0))
    with pytest.raises(DataProblem):
        R.checked_shape(df, max_columns=1)
    with pytest.raises(DataProblem):
        R.checked_shape(df.union(df), max_rows=1)
    with pytest.raises(DataProblem):
        R.read_table(spark, "x.xlsx")


def test_formula_cells_and_headers(spark):
    rows = [("=1+1", -2), ("  +x", 3), ("-a", 4), ("@b", 5), ("plain = x", 6), (None, 7)]
    safe = W.neutralize_formulas(spark.createDataFrame(rows, "label string, `=v` long"))
    assert safe.columns == ["label", "'=v"]
    assert [tuple(r) for r in safe.collect()] == [
        ("'=1+1", -2), ("'  +x", 3), ("'-a", 4), ("'@b", 5), ("plain = x", 6), (None, 7),
    ]


def test_json_values(spark, tmp_path):
    df = spark.sql(
        "SELECT double('NaN') a, double('Infinity') b, 1.5D c, date'2024-01-02' d, timestamp'2024-01-02 03:04:05' e, "
        "timestamp'2024-01-02 03:04:05.5' f"
    )
    W.write_json_table(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {
        "a": None, "b": None, "c": 1.5, "d": "2024-01-02", "e": "2024-01-02T03:04:05", "f": "2024-01-02T03:04:05.500000",
    }


def test_contract_rules():
    assert check_contract({"research_question": "q", "intended_use": " "}) == [
        "corpus_definition", "intended_use", "unit_definition", "language_policy", "human_validation_plan",
    ]
    with pytest.raises(DataProblem):
        check_contract({"group": "g", "focal_group": "a", "reference_group": "a"})
    with pytest.raises(DataProblem):
        check_contract({"human_label_column": "h", "negative_label": "a", "positive_label": "a"})


def test_missing_marks_in_numbers_and_strict_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,score,day\na,1,2025-01-02\nb,n/a,\nc,3\n,NULL,2025-01-03\n")
    df = R.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"name": "string", "score": "bigint", "day": "date"}
    assert [r["score"] for r in df.orderBy(F.col("name").asc_nulls_last()).collect()] == [1, None, 3, None]
    typed = R.read_csv(spark, str(tmp_path / "a.csv"), schema="who string, points double, at string")
    assert [r["points"] for r in typed.orderBy(F.col("who").asc_nulls_last()).collect()] == [1.0, None, 3.0, None]
    (tmp_path / "b.csv").write_text("name,score\na,1\nb,2,lost\n")
    with pytest.raises(Exception, match="more cells"):
        R.read_csv(spark, str(tmp_path / "b.csv")).select("score").collect()


@pytest.mark.parametrize("head", [4096, 2])
def test_json_shape_is_decided_for_each_file(spark, tmp_path, monkeypatch, head):
    """From the first bytes, or through Spark where these do not tell."""
    monkeypatch.setattr(R, "HEAD_BYTES", head)
    folder = tmp_path / "rows"
    folder.mkdir()
    (folder / "1.json").write_text('[{"a": 1}, {"a": 2}]')
    (folder / "2.json").write_text('{"data": [{"a": 3}]}')
    for schema in (None, "a long"):
        assert sorted(r["a"] for r in R.read_json(spark, str(folder), schema=schema).collect()) == [1, 2, 3]
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a"')
    with pytest.raises(Exception):
        R.read_json(spark, str(tmp_path / "cut.json"), schema="a long").collect()


def test_table_with_its_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    df, source = R.read_with_source(spark, str(tmp_path / "a.csv"))
    assert df.count() == 1
    assert source["files"] == [{"source_filename": "a.csv", "source_sha256": hashlib.sha256(b"a,b\n1,x\n").hexdigest()}]


def test_csv_rows_of_other_lengths(spark, tmp_path):
    """A surplus cell in whatever place is refused, also where quoted cells hold commas; a short row is filled."""
    good = tmp_path / "good.csv"
    good.write_text('__spare_0,_row\n1,"a,b"\n2\n"3,,,",\n')
    read = R.read_csv(spark, str(good), schema="__spare_0 string, _row string")
    assert sorted(map(tuple, read.collect()), key=str) == [("1", "a,b"), ("2", None), ("3,,,", None)]
    assert read.select("_row").count() == 3 and read.count() == 3
    for row in ("3,4,,,,,lost", "3,4,", '"3,x",4,"y"', '3,4,"a\n,b"'):
        bad = tmp_path / "bad.csv"
        bad.write_text(f"a,b\n1,2\n{row}\n")
        with pytest.raises(Exception, match="more cells"):
            R.read_csv(spark, str(bad), schema="a string, b string").collect()


def test_long_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    from lexprism.sources import readers

    monkeypatch.setattr(readers, "WHOLE_FILE_BYTES", 1000)
    contents = {"short one.txt": b"abc", "long one.bin": bytes(range(256)) * 20_000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = {tuple(r) for r in readers.file_fingerprints(spark, str(tmp_path)).collect()}
    assert found == {(name, hashlib.sha256(content).hexdigest()) for name, content in contents.items()}


def test_the_line_source_is_written_in_as_many_parts_as_the_session_deals(spark, tmp_path, monkeypatch):
    from catalog import queries

    rows = [(i, f" line\t{i} é") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    paths, read = [], R.read_lines
    monkeypatch.setattr(R, "read_lines", lambda session, path: paths.append(path) or read(session, path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries.QUERIES["line_source"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found)) == [(f"TXT-{i + 1:06d}", f"line {i} é") for i in range(400)]
    assert len(spark.read.text(paths[0]).inputFiles()) > 4
