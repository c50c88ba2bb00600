"""Where intermediate tables are written, and how small inputs are spread."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_PER_SLOT = 16 * 1024 * 1024
_UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="lexprism-")


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh path below ``folder``, else below the shared folder named in spark.checkpoint.dir.

    With neither, a folder of this machine serves a single-machine session
    (master ``local`` or ``local[n]``); any other session is refused, since its
    executors could not read each other's files.
    """
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/lexprism/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write an intermediate table once and read it back.

    The written table cuts lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _estimated_bytes(df: DataFrame) -> int | None:
    """The planner's size estimate, without running a job; None where it gives none."""
    plan = df.sparkSession.sql("EXPLAIN COST SELECT * FROM {df}", df=df).first()[0]
    found = re.search(r"sizeInBytes=([\d.]+(?:E[+-]?\d+)?) (B|KiB|MiB|GiB)\b", plan)
    return int(float(found[1]) * _UNITS[found[2]]) if found else None


def evened(df: DataFrame) -> DataFrame:
    """Spread a small input, which may be a single file split, over the task slots.

    The rows are the same either way; an input estimated above 16 MiB for each
    slot already has more splits than slots and is returned as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    estimate = _estimated_bytes(df)
    return df.repartition(slots) if estimate is not None and estimate <= slots * SMALL_PER_SLOT else df


def pin_utc(spark: SparkSession) -> None:
    """Periods are calendar periods in UTC, whatever the machine's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
