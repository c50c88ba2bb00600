"""Sinks: formula-safe CSV tables and JSON evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.stats import finite_or_null

FORMULA = r"(?U)^\s*[=+\-@]"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def neutralized(column: Column) -> Column:
    """A leading apostrophe before text a spreadsheet would run as a formula."""
    return F.when(column.rlike(FORMULA), F.concat(F.lit("'"), column)).otherwise(column)


def neutralize_formulas(df: DataFrame) -> DataFrame:
    """Text cells and headers made safe; other types stay as they are."""
    cells = [
        neutralized(F.col(_quoted(f.name))) if isinstance(f.dataType, S.StringType) else F.col(_quoted(f.name))
        for f in df.schema.fields
    ]
    headers = ["'" + name if name.lstrip().startswith(("=", "+", "-", "@")) else name for name in df.columns]
    return df.select(*[cell.alias(name) for cell, name in zip(cells, headers)])


def json_ready(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null, dates and times ISO text."""

    def cell(field: S.StructField) -> Column:
        column = F.col(_quoted(field.name))
        if isinstance(field.dataType, (S.DoubleType, S.FloatType)):
            return finite_or_null(column).alias(field.name)
        if isinstance(field.dataType, S.TimestampType):
            fraction = F.date_format(column, ".SSSSSS")
            seconds = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            return F.concat(seconds, F.when(fraction != ".000000", fraction).otherwise("")).alias(field.name)
        if isinstance(field.dataType, S.DateType):
            return column.cast("string").alias(field.name)
        return column

    return df.select(*[cell(field) for field in df.schema.fields])


def write_csv_table(df: DataFrame, path: str) -> None:
    """One CSV directory; nested values are not allowed in a CSV cell."""
    writer = neutralize_formulas(df).write.mode("errorifexists").options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    writer.csv(path)


def write_json_table(df: DataFrame, path: str) -> None:
    json_ready(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
