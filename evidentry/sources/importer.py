"""Import of local evidence: strict reading, contract, order, pseudonyms, shards, manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeline import stored
from ..operators import contracts, pseudonym
from . import jsonl, shards

IMPORT = "_import"
RECORD = ("dataset string, pilot string, domain_id string, schema_version string, events long, shards long, bytes long, "
          "first_us long, last_us long, quarantined long, out_of_order long, warnings array<string>, "
          "reasons array<struct<reason:string,n:long>>")
#: What a published folder may hold besides its shards.
OWN_FILES = r"(^|/)(_manifest|_import)/part-[^/]*\.json$|/_SUCCESS$|\.crc$"


class ImportRefused(ValueError):
    """The input breaks its contract; nothing was published."""


def import_evidence(spark: SparkSession, source: str, target: str, key: bytes, dataset: str, pilot: str,
                    version: str = contracts.LOCAL_INPUT_VERSION, max_quarantined: int = 0, max_out_of_order: int = 0,
                    shard_size: int = 1_000_000, max_by_reason: dict[str, int] | None = None) -> DataFrame:
    """Read `source` (JSON Lines) and publish it under `target`; returns the import's record.

    It fails closed: with more than `max_quarantined` bad lines, more of a reason than `max_by_reason` allows it, or `max_out_of_order` lines
    older than the line before, `ImportRefused` is raised before anything is written to
    `target`. Shards hold daily pseudonyms only. The record is written last, so a folder
    without it is not complete. Tolerated faults are named as warnings.
    """
    valid, bad = jsonl.read_evidence_jsonl(spark, source, version)
    valid = stored(valid, "import")
    by_reason = {r["reason"]: r["n"] for r in bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    quarantined = sum(by_reason.values())
    if quarantined > max_quarantined:
        raise ImportRefused(f"{quarantined} lines break the contract: {json.dumps(by_reason, sort_keys=True)}")
    above = {r: by_reason[r] for r, most in (max_by_reason or {}).items() if by_reason.get(r, 0) > most}
    if above:
        raise ImportRefused(f"more lines than a reason may have: {json.dumps(above, sort_keys=True)}")
    out_of_order = contracts.check_chronology(valid, "observed_at", "line_no", "source_split").count()
    if out_of_order > max_out_of_order:
        raise ImportRefused(f"{out_of_order} lines are older than the line before")
    rows = pseudonym.assert_no_direct_refs(pseudonym.pseudonymise(valid, key, dataset, pilot))
    manifest = shards.publish_evidence(rows, target, shard_size)
    warnings = [f"quarantined:{r}" for r in sorted(by_reason)] + (["out_of_order"] if out_of_order else [])
    record = shards.published_summary(manifest).select(
        F.lit(dataset).alias("dataset"), F.lit(pilot).alias("pilot"),
        F.lit(pseudonym.domain_id(pseudonym.domain_key(key, dataset, pilot))).alias("domain_id"),
        F.lit(version).alias("schema_version"), "events", "shards", "bytes", "first_us", "last_us",
        F.lit(quarantined).cast("long").alias("quarantined"), F.lit(out_of_order).cast("long").alias("out_of_order"),
        F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"),
        F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(k).cast("long").alias("n")) for r, k in sorted(by_reason.items())])
        .cast("array<struct<reason:string,n:long>>").alias("reasons"))
    record.coalesce(1).write.mode("errorifexists").json(f"{target}/{IMPORT}")
    return read_import(spark, target)


def read_import(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(RECORD).json(f"{target}/{IMPORT}")


def verify_import(spark: SparkSession, target: str) -> DataFrame:
    """(file, problem) of a published import; empty = sound.

    Shards are compared with the manifest (missing, undeclared, size, hash, records, time
    range), the manifest's totals with the import's record (totals), and every other file
    in the folder is undeclared. A folder without a completed record raises on reading.
    """
    problems = shards.verify_published(spark, target)
    totals = shards.published_summary(shards.read_manifest(spark, target))
    record = read_import(spark, target)
    same = ["events", "shards", "bytes", "first_us", "last_us"]
    wrong = record.select(*same).exceptAll(totals.select(*same)).select(
        F.lit(IMPORT).alias("file"), F.lit("totals").alias("problem"))
    # hidden files are what a reader would not list, so the folder's own listing is asked
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    found, listing = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    while listing.hasNext():
        found.append(listing.next().getPath().toString().removeprefix(base).lstrip("/"))
    files = spark.createDataFrame([(f,) for f in found], "file string")
    shard = F.col("file").rlike(rf"^{shards.DATA}/[^/]*\.parquet$")
    strange = files.filter(~shard & ~F.col("file").rlike(OWN_FILES)).select("file", F.lit("undeclared").alias("problem"))
    return problems.unionByName(wrong).unionByName(strange)
