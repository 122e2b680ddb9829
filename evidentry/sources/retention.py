"""A table with one partition a day: idempotent writes, pruned reads, expiry by whole days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeline import open_files
from ..operators.contracts import oldest_kept

DAY = "day"
OPEN_DAYS = 16  # files that a writing task keeps open


def write_dated(df: DataFrame, path: str, time: str = "recorded_at") -> None:
    """Write `df` by day of `time` (UTC). The days that `df` holds are replaced, all others stay, so a retry changes nothing.

    Days are balanced over tasks by their size: a day with a third of all rows is written by many. Rows without a
    time go to the partition of no day, which never expires. A task sorts only rows of days beyond its first `OPEN_DAYS`.
    """
    with open_files(df.sparkSession, OPEN_DAYS):
        (df.withColumn(DAY, F.to_date(time)).hint("rebalance", DAY).write.partitionBy(DAY)
         .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_retained(spark: SparkSession, path: str, now, keep_days: int = 7, time: str = "recorded_at", schema=None) -> DataFrame:
    """Rows of at most `keep_days` before `now` (a timestamp, 1 to 90 days); older days are not even listed for reading."""
    reader = spark.read.schema(f"{schema}, {DAY} date") if schema else spark.read
    oldest = oldest_kept(F.lit(now).cast("timestamp"), keep_days)
    table = reader.parquet(path)
    return table.filter((F.col(DAY) >= F.to_date(oldest)) & (F.col(time) >= oldest)).drop(DAY)


def drop_expired(spark: SparkSession, path: str, now, keep_days: int = 7) -> list[str]:
    """Delete the partitions of days that ended before the retention; returns them. One listing, one delete a day."""
    first = spark.range(1).select(F.to_date(oldest_kept(F.lit(now).cast("timestamp"), keep_days)).alias("d")).first()["d"].isoformat()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        day = name.removeprefix(f"{DAY}=")
        if status.isDirectory() and day != name and len(day) == 10 and day < first:
            files.delete(status.getPath(), True)
            gone.append(day)
    return sorted(gone)
