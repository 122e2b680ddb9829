"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeline import shared_folder

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    It is used where a result is needed more than once or its lineage must be cut; lost
    executors then cost a read, and readers still prune columns.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frequent(counts: DataFrame, n: str = "n") -> DataFrame:
    """Rows of `counts` (one per key) whose number `n` is over a quarter of a shuffle task's even share.

    There are fewer than four of them per shuffle partition, whatever the data, so they can be broadcast.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > total // (4 * partitions(counts.sparkSession)))


def words_of(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal for equal texts, 128 bits against accidents."""
    return [F.xxhash64(*columns).alias("digest_a"),
            F.xxhash64(F.lit("second"), *columns).alias("digest_b")]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that `column` has about `max_bytes` in each slice (one row at least)."""
    import numpy as np

    values = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    group = np.cumsum(size) // max_bytes
    edges = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)
