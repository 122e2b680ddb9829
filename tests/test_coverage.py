"""Coverage verdicts against a plain fold, in chunks too; counters that fall once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from evidentry import vocab as V
from evidentry.operators import telemetry
from evidentry.vocab import MICROS

SCHEMA = "source_id string, line_no long, us long, sequence long, started long, done long, base long, wrong boolean"


def reports(spark, rows):
    counters = F.array(*[F.struct(
        F.lit(name).alias("endpoint_class"), (F.col("base") * 10 + F.col("wrong").cast("int")).alias("protected"), (F.col("base") * 4).alias("evaluated"),
        (F.col("base") * 2).alias("bypassed"), F.col("base").alias("rejected"), (F.col("base") * 3).alias("granted_retries"))
        for name in V.ENDPOINT_CLASSES])
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    return df.select("source_id", "line_no", F.timestamp_micros("us").alias("received_at"), "sequence",
                     F.timestamp_micros("started").alias("source_started_at"), F.timestamp_micros("done").alias("completed_at"), counters.alias("endpoints"))


def plain(rows):
    last, out = {}, {}
    for s, line, us, seq, started, done, base, wrong in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if wrong or seq < 1 or done < started:
            out[s, line] = "invalid"
            continue
        now = (started, seq, done, base)
        if s not in last:
            out[s, line] = "accepted"
        elif last[s] == now:
            out[s, line] = "unchanged"
            continue
        else:
            p = last[s]
            out[s, line] = "accepted" if p[0] == started and seq > p[1] and done >= p[2] and base >= p[3] else "conflict"
        if out[s, line] == "accepted":
            last[s] = now
    return out


def verdicts(df, **more):
    return {(r.source_id, r.line_no): r.verdict for r in telemetry.accept_coverage(df, **more).collect()}


@pytest.mark.parametrize("chunk", [10**6, 3, 50, 400])
def test_equals_a_fold(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for n, s in enumerate(("a" * 32, "b" * 32, "c" * 32)):
        for i in range((5, 300, 1_500)[n]):
            us = (i + rng.choice([0, 0, 0, 7])) * MICROS
            rows.append((s, i, us + 100 * MICROS, max(0, i - rng.choice([0] * 9 + [3])) // (1 + rng.randrange(2)), rng.choice([0] * 30 + [MICROS]),
                         us - rng.choice([0] * 8 + [9]) * MICROS if us > 9 * MICROS else us, max(0, i - rng.choice([0] * 9 + [40])), rng.random() < 0.05))
    for i, r in enumerate(rows):
        if i and i % 5 == 0 and r[0] == rows[i - 1][0]:
            rows[i] = (r[0], r[1], r[2], *rows[i - 1][3:])
    got = verdicts(reports(spark, rows).repartition(4), rows_per_chunk=chunk)
    assert got == plain(rows) and set(got.values()) == {"accepted", "conflict", "unchanged", "invalid"}


@pytest.mark.parametrize("chunk", [10**6, 5_000])
def test_counters_that_fall(spark, chunk):
    """A source falls once, and a hundred thousand reports of less follow, some rising, some falling; then it comes back."""
    i = F.col("id")
    rows = spark.range(100_003).select(
        F.lit("d" * 32).alias("source_id"), i.alias("line_no"), (i * MICROS).alias("us"), (i + 1).alias("sequence"), F.lit(0).cast("long").alias("started"),
        (i * MICROS).alias("done"), F.when(i < 2, 10**9 + i).when(i == 100_002, 2 * 10**9).when(i % 2 == 0, 200_000 - i).otherwise(i).alias("base"),
        F.lit(False).alias("wrong"))
    counted = telemetry.accept_coverage(reports(spark, rows), rows_per_chunk=chunk).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in counted} == {"accepted": 3, "conflict": 100_000}


def test_chunks_are_dealt_evenly(spark):
    """Chunks do not meet in a task by chance: as many tasks as chunks have one each, and whole chunks of the rows stay together."""
    rows = spark.range(50).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source_id"), (F.col("id") % 16).alias("chunk"))
    slots, tasks = telemetry._slots(rows, telemetry.REPORTS_PER_TASK)
    assert sorted(r.slot for r in slots.collect()) == list(range(48)) and tasks == 48
    assert telemetry._slots(rows, telemetry.REPORTS_PER_TASK // 100)[1] == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_task_folds_one_chunk(spark, monkeypatch):
    """Eight sources of four chunks: no task of the fold gets reports of two chunks."""
    monkeypatch.setattr(telemetry, "REPORTS_PER_TASK", 25, raising=False)
    i, tasks = F.col("id"), []
    rows = spark.range(800).select(
        F.lpad((i % 8).cast("string"), 32, "e").alias("source_id"), i.alias("line_no"), (i * MICROS).alias("us"), (i + 1).alias("sequence"),
        F.lit(0).cast("long").alias("started"), (i * MICROS).alias("done"), i.alias("base"), F.lit(False).alias("wrong"))
    dealt = DataFrame.mapInArrow

    def watched(df, *args, **more):
        tasks.append(df.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("source_id", "chunk").alias("n")).agg(F.max("n")).first()[0])
        return dealt(df, *args, **more)
    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    got = telemetry.accept_coverage(reports(spark, rows), rows_per_chunk=25)
    assert {r.verdict: r["count"] for r in got.groupBy("verdict").count().collect()} == {"accepted": 800}
    assert max(n for n in tasks if n is not None) == 1


def test_empty(spark):
    assert telemetry.accept_coverage(reports(spark, [])).count() == 0
