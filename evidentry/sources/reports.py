"""Publishing report tables: create-only, or as versions of which readers take the newest."""

from __future__ import annotations

import time as _time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish_report(df: DataFrame, path: str, replace: bool = False, version: int | None = None) -> str:
    """Write a report and return where.

    Create-only by default. With `replace` the report becomes a new version; the job
    commits a version as a whole, so a failed run leaves the last valid one in place.
    """
    target = path
    if replace:
        version = _time.time_ns() // 1000 if version is None else version
        target = f"{path}/version={version}"
    df.coalesce(1).write.mode("errorifexists").parquet(target)  # a report is a few rows
    return target


def read_latest_report(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; partition pruning reads that folder only."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("v")).first()["v"]
    return versions.filter(F.col("version") == newest).drop("version")
