"""Streaming jobs with sinks: re-published reports and late-row routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import micros
from ..sources.reports import publish_report
from .ordered import LATE


def watch_report(stream: DataFrame, table_path: str, analyse: Callable[[DataFrame], DataFrame],
                 report_path: str, checkpoint: str, every: str = "30 seconds",
                 available_now: bool = False) -> StreamingQuery:
    """Re-run `analyse` over an append table whenever new rows arrive.

    Each trigger publishes a new report version (its batch id), so a retried batch
    writes the same version and readers keep the last complete one.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{report_path}/version={batch_id}"
        table = spark.read.schema(batch.schema).parquet(table_path)
        if not _complete(spark, target):
            publish_report(analyse(table), report_path, replace=True, version=batch_id)

    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def route_late(stream: DataFrame, time: str, delay_us: int, on_time_path: str, late_path: str,
               checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Split a stream into an on-time and a late table; no row is dropped.

    A row is late when it is older than the newest time of the batches before it minus
    the delay. That time is kept with every batch, so a restarted query continues from it.
    Batches are written as partitions that a retry overwrites.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, on_time_path, batch_id)
        bound = None if newest is None else newest - delay_us
        us = micros(time)
        late = F.lit(False) if bound is None else us < bound
        high = batch.agg(F.max(us)).first()[0]
        mark = max(x for x in (newest, high, 0) if x is not None)
        for path, rows in ((on_time_path, batch.filter(~late)), (late_path, batch.filter(late))):
            rows.withColumn("_mark_us", F.lit(mark)).write.mode("overwrite").parquet(
                f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_with_late(stream: DataFrame, on_time_path: str, late_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the output of an ordered operator and the rows that came behind its watermark into two tables, by one query.

    Batches are partitions that a retry overwrites.
    """
    late_columns = [stream.columns[0], *LATE]

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        late = F.col(LATE[0]).isNotNull()
        batch.filter(~late).drop(*LATE).write.mode("overwrite").parquet(f"{on_time_path}/batch_id={batch_id}")
        batch.filter(late).select(*late_columns).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _newest(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """Newest time seen before a batch."""
    for earlier in range(batch_id - 1, -1, -1):
        if _complete(spark, f"{path}/batch_id={earlier}"):
            found = spark.read.parquet(f"{path}/batch_id={earlier}").agg(F.max("_mark_us")).first()[0]
            if found is not None:
                return found
    return None
