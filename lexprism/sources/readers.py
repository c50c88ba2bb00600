"""Sources: CSV, JSON rows, one document per line, Parquet, and fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..config import DataProblem
from ..session import materialise

# Cell texts read as missing.
MISSING_MARKS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
MOST_BROADCAST_SPLITS = 100_000
MOST_LISTED_FILES = 1_000
WHOLE_FILE_BYTES = 1 << 30
PIECE_BYTES = 1 << 20
HEAD_BYTES = 1 << 12
BYTE_ORDER_MARK = "﻿"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def checked_shape(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Trim column names; refuse empty, blank-named, doubled or oversized tables.

    Names that differ in case only are different columns, as in the source; the
    session is switched to case-sensitive names where a table has such columns.
    """
    names = [name.strip() for name in df.columns]
    if len({name.lower() for name in names}) < len(set(names)):
        df.sparkSession.conf.set("spark.sql.caseSensitive", "true")
    if max_columns is not None and len(names) > max_columns:
        raise DataProblem(f"The table has {len(names)} columns; at most {max_columns} are allowed.")
    if not all(names):
        raise DataProblem("A column has no name.")
    if len(set(names)) != len(names):
        raise DataProblem("Two columns share a name.")
    if df.isEmpty():
        raise DataProblem("The table has no rows.")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise DataProblem(f"The table has more than {max_rows} rows.")
    return df.toDF(*names)


def _narrowest(texts: DataFrame) -> dict[str, str]:
    """The narrowest type that reads every cell of each text column, in one pass."""
    kinds = ("bigint", "double", "date", "timestamp", "boolean")
    unreadable = [
        F.count_if(F.col(_quoted(name)).isNotNull() & F.col(_quoted(name)).try_cast(kind).isNull()).alias(f"{i}_{kind}")
        for i, name in enumerate(texts.columns)
        for kind in kinds
    ]
    filled = [F.count(F.col(_quoted(name))).alias(f"{i}_n") for i, name in enumerate(texts.columns)]
    found = texts.agg(*filled, *unreadable).first()
    out = {}
    for i, name in enumerate(texts.columns):
        fitting = [kind for kind in kinds if found[f"{i}_{kind}"] == 0]
        out[name] = fitting[0] if found[f"{i}_n"] and fitting else "string"
    return out


def read_csv(
    spark: SparkSession,
    path: str,
    schema: S.StructType | str | None = None,
    na_values: Iterable[str] = MISSING_MARKS,
    multiline: bool = True,
    **limits,
) -> DataFrame:
    """CSV with a header row. Give a schema for large inputs: finding types reads them twice.

    Cells are read as text and missing marks removed before types are found or
    cast, so a mark in a numeric column is a missing number. A row with more
    cells than the header, or a cell its declared type cannot hold, fails the
    read; a short row is filled with nulls. Quoted cells may span lines; with
    ``multiline=False`` they may not, and one large file is then split over tasks.
    """
    marks = list(na_values)
    reader = spark.read.options(
        header=True, multiLine=multiline, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    names = reader.csv(path).columns
    whole = "_row"  # the text of a row that has not as many cells as the header
    while whole.lower() in {name.lower() for name in names}:
        whole += "_"
    schema_of_rows = S.StructType([S.StructField(name, S.StringType()) for name in [*names, whole]])
    rows = reader.option("columnNameOfCorruptRecord", whole).schema(schema_of_rows).csv(path)
    outside = F.regexp_replace(whole, r'(^|,)"(?:[^"]++|"")*+"', "$1")  # without quoted cells
    too_long = F.col(whole).isNotNull() & (F.regexp_count(outside, F.lit(",")) >= len(names))
    message = F.concat(F.lit("A CSV row has more cells than the header: "), F.coalesce(F.col(_quoted(names[0])), F.lit("")))
    rows = rows.where(F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))

    def cell(name: str):
        column = F.col(_quoted(name))
        return F.when(~column.isin(marks), column).alias(name)

    texts = checked_shape(rows.select(*[cell(name) for name in names]), **limits)
    if schema is not None:
        wanted = S.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if len(wanted) != len(texts.columns):
            raise DataProblem(f"The schema has {len(wanted)} columns, the file {len(texts.columns)}.")
        pairs = [(name, field.name, field.dataType) for name, field in zip(texts.columns, wanted)]
        return texts.select(*[F.col(_quoted(name)).cast(kind).alias(new) for name, new, kind in pairs])
    return texts.select(*[F.col(_quoted(name)).cast(kind).alias(name) for name, kind in _narrowest(texts).items()])


def _streams(uris: list[str]) -> Iterator[pa.NativeFile]:
    """Open files one after the other, wherever Arrow can open them."""
    for uri in uris:
        store, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(uri, safe="/:@")))
        with store.open_input_stream(place) as stream:
            yield stream


def _first_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first character of each file that is no blank; none where its beginning does not tell or cannot be read."""
    for batch in batches:
        marks = []
        for uri in batch.column(0).to_pylist():
            try:
                head = b"".join(stream.read(HEAD_BYTES) for stream in _streams([uri]))
            except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store only Spark reads
                head = b""
            marks.append(head.decode("utf-8", "ignore").lstrip(BYTE_ORDER_MARK).strip()[:1] or None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], ["path", "mark"])


def _shapes(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files whose top level is an array, and those whose top level is an object; only their first bytes are read.

    Where the first bytes cannot be had, what precedes a file's first brace is looked at through Spark's text reader.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    marks = {r["path"]: r["mark"] for r in files.mapInArrow(_first_marks, "path string, mark string").collect()}  # one row for each file
    unknown = [file for file, mark in marks.items() if mark is None]
    if unknown:
        heads = spark.read.option("lineSep", "{").text(unknown).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        first = heads.where("start = 0").withColumn("at", F.monotonically_increasing_id())
        before = first.groupBy("file").agg(F.min_by("value", "at").alias("head")).collect()
        marks = {file: mark for file, mark in marks.items() if mark is not None}
        marks |= {r["file"]: r["head"].lstrip(BYTE_ORDER_MARK).strip()[:1] for r in before}
    return [file for file, mark in marks.items() if mark == "["], [file for file, mark in marks.items() if mark != "["]


def read_json(spark: SparkSession, path: str, schema: S.StructType | str | None = None, **limits) -> DataFrame:
    """An array of row objects, or an object with a ``data`` array of them; decided for each file.

    A file that is no JSON of this kind fails the read.
    """
    reader = spark.read.options(multiLine=True, mode="FAILFAST")
    try:
        return checked_shape(_json_rows(spark, reader, path, schema), **limits)
    except DataProblem:
        raise
    except Exception as error:  # schema inference reports bad files in several ways
        raise DataProblem("A JSON file cannot be read as a table.") from error


def _json_rows(spark: SparkSession, reader: DataFrameReader, path: str, schema: S.StructType | str | None) -> DataFrame:
    arrays, objects = _shapes(spark, path)
    parts = []
    if arrays:
        parts.append((reader.schema(schema) if schema is not None else reader).json(arrays))
    if objects:
        if schema is not None:
            inner = S.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            wrapped = reader.schema(S.StructType([S.StructField("data", S.ArrayType(inner))])).json(objects)
        else:
            wrapped = reader.json(objects)
        fields = {f.name: f.dataType for f in wrapped.schema.fields}
        rows_type = fields.get("data")
        if not isinstance(rows_type, S.ArrayType) or not isinstance(rows_type.elementType, S.StructType):
            raise DataProblem("JSON must be an array of row objects or an object with a data array.")
        parts.append(wrapped.select(F.inline("data")))
    if not parts:
        raise DataProblem("The table has no rows.")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_lines(spark: SparkSession, path: str, **limits) -> DataFrame:
    """One document per non-blank line, with dense identifiers in file order.

    The lines are written once with their place in their split, so counting and
    numbering see the same places; each split counts its lines, and the table of
    splits, one row each, gives every split its offset.
    """
    raw = spark.read.text(path).select(
        F.trim(F.regexp_replace(F.ltrim(F.regexp_replace("value", f"^{BYTE_ORDER_MARK}", "")), r"(?U)^\s+|\s+$", "")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    lines = materialise(raw.filter("text <> ''").withColumn("seen", F.monotonically_increasing_id()), "lines")
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.col("offset") + F.col("seen") - F.col("first") + 1
    few = offsets.limit(MOST_BROADCAST_SPLITS + 1).count() <= MOST_BROADCAST_SPLITS
    numbered = lines.join(F.broadcast(offsets) if few else offsets, ["file", "start"]).select(
        F.format_string("TXT-%06d", number).alias("document_id"), "text"
    )
    return checked_shape(numbered, **limits)


def read_parquet(spark: SparkSession, path: str, **limits) -> DataFrame:
    return checked_shape(spark.read.parquet(path), **limits)


READERS = {".csv": read_csv, ".json": read_json, ".txt": read_lines, ".parquet": read_parquet}


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by file ending."""
    for ending, reader in READERS.items():
        if path.rstrip("/").lower().endswith(ending):
            return reader(spark, path, **options)
    raise DataProblem(f"Supported file endings: {', '.join(READERS)}.")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``source_filename, source_sha256`` per file that is not empty.

    Files up to ``WHOLE_FILE_BYTES`` come through Spark's reader; a larger one
    is read in the task in pieces of a megabyte, so its size bounds nothing. For
    that its store must be one that Arrow can open.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("source_filename")
    short = files.where(F.col("length") <= WHOLE_FILE_BYTES).select(name, F.sha2("content", 256).alias("source_sha256"))
    long = files.where(F.col("length") > WHOLE_FILE_BYTES).select("path")
    if long.isEmpty():
        return short
    each = long.repartition("path").mapInArrow(_streamed_digests, "path string, source_sha256 string")
    return short.unionByName(each.select(name, "source_sha256"))


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for stream in _streams(batch.column(0).to_pylist()):
            digest = hashlib.sha256()
            while piece := stream.read(PIECE_BYTES):
                digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "source_sha256"])


def read_with_source(spark: SparkSession, path: str, **options) -> tuple[DataFrame, dict]:
    """A table and the record of where it came from: each file's name and hash, or the rows' hash where there are many files."""
    df = read_table(spark, path, **options)
    files = file_fingerprints(spark, path).orderBy("source_filename").limit(MOST_LISTED_FILES + 1).collect()
    if len(files) > MOST_LISTED_FILES:
        return df, {"path": path, **content_fingerprint(df).first().asDict()}
    return df, {"path": path, "files": [row.asDict() for row in files]}


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies a table's rows in any order and partitioning.

    Each row is hashed with SHA-256 and the leading 60 bits are summed exactly.
    """
    cells = [F.coalesce(F.col(_quoted(c)).cast("string"), F.lit("\\N")) for c in df.columns]
    digits = F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15)
    value = F.conv(digits, 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(value).cast("string").alias("digest"))
