"""Publishing evidence as chronological shards with a manifest, and verifying it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import micros

MANIFEST = "_manifest"
DATA = "shards"


def row_digest(*columns: Column) -> Column:
    """60 bits of SHA-256 over the given texts, parted by `|`; NULL counts as empty. Their sum does not depend on the order."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def shard_contents(spark: SparkSession, path: str, digest: Column, time: str = "observed_at") -> DataFrame:
    """One row: what the published rows are, whatever the files: records, sum of `digest`, the largest shard, and how many
    shards begin before the one that comes before them ends."""
    us = micros(time)
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{path}/{DATA}").select(
        F.col("_metadata.file_name").alias("file"), us.alias("us"), digest.alias("d"))
    per_file = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d").cast("decimal(38,0)")).alias("d"),
                                        F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    # one row a shard
    before = F.lag("last_us").over(Window.orderBy("first_us", "last_us", "file"))
    return per_file.withColumn("overlaps", (F.col("first_us") < before).cast("long")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"), F.sum("d").cast("string").alias("digest"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"))


def publish_evidence(df: DataFrame, path: str, shard_size: int = 1_000_000, time: str = "observed_at",
                     line: str = "line_no") -> DataFrame:
    """Write `df` as time-ordered shards of at most `shard_size` records; return the manifest.

    Never overwrites. Spark's `_SUCCESS` file marks completion: a failed job leaves no
    marker and no manifest.
    """
    spark = df.sparkSession
    total = df.count()
    parts = max(1, -(-total // shard_size))
    (df.repartitionByRange(parts, time, line).sortWithinPartitions(time, line)
     .write.mode("errorifexists").option("maxRecordsPerFile", shard_size).parquet(f"{path}/{DATA}"))
    listing = describe_shards(spark, path, time)
    listing.write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def describe_shards(spark: SparkSession, path: str, time: str = "observed_at") -> DataFrame:
    """file, bytes, sha256, records, first_us, last_us of what is really in the folder.

    Shards are bounded by construction, so hashing one is bounded work for a task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(
        f"{path}/{DATA}").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"))
    us = micros(time)
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{path}/{DATA}").select(
        F.col("_metadata.file_name").alias("file"), us.alias("us")).groupBy("file").agg(
        F.count(F.lit(1)).alias("records"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return files.join(rows, "file", "left").fillna(0, ["records"])


SHARD = "file string, bytes long, sha256 string, records long, first_us long, last_us long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).json(f"{path}/{MANIFEST}")


def compare_shards(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(file, problem) for every declared or found shard that does not match; empty = ok."""
    both = declared.alias("d").join(found.alias("f"), F.col("d.file") == F.col("f.file"), "full_outer")
    same = lambda c: F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}"))
    problem = (F.when(F.col("f.file").isNull(), F.lit("missing"))
               .when(F.col("d.file").isNull(), F.lit("undeclared"))
               .when(~same("bytes"), F.lit("size")).when(~same("sha256"), F.lit("hash"))
               .when(~same("records"), F.lit("records"))
               .when(~(same("first_us") & same("last_us")), F.lit("time_range")))
    return (both.select(F.coalesce("d.file", "f.file").alias("file"), problem.alias("problem"))
            .filter("problem IS NOT NULL"))


def verify_published(spark: SparkSession, path: str, time: str = "observed_at") -> DataFrame:
    """Differences between the manifest and the folder."""
    return compare_shards(read_manifest(spark, path), describe_shards(spark, path, time))


def published_summary(manifest: DataFrame) -> DataFrame:
    """One row: shards, events, bytes and time range."""
    return manifest.agg(
        F.count(F.lit(1)).cast("long").alias("shards"),
        F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("events"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
