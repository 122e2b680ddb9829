"""Greedy chains against a plain scan; hot keys by jump tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentry.functions.greedy import greedy_chain
from evidentry.functions.timeline import ranked
from evidentry.operators import identity, windows
from evidentry.vocab import MICROS, MINUTE_US

SCHEMA = "k string, j int, t long, u long, line long"


def scan(rows):
    taken, until = [], {}
    for k, j, t, u, line in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[4])):
        if (k, j) not in until or (until[k, j] is not None and t >= until[k, j]):
            until[k, j] = u
            taken.append((k, j, t, line))
    return sorted(taken, key=str)


@pytest.mark.parametrize("few,chunk", [(10_000, 10_000), (0, 7), (20, 1_000), (50, 13)])
def test_equals_a_scan(spark, few, chunk):
    rng = random.Random(few + chunk)
    rows = [(rng.choice("abcccc"), 0, t := rng.randrange(300), t + rng.randint(1, 40), i) for i in range(400)]
    rows += [("gap", 1, i, None if i == 5 else i + 2, i) for i in range(40)] + [("one", 1, 3, 4, 9)]
    rows += [("same", 1, 7, 8 + i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = greedy_chain(df, ["k", "j"], "t", "u", "line", few, chunk)
    assert got.columns == ["k", "j", "t", "line"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == scan(rows)
    assert greedy_chain(df.limit(0), ["k", "j"], "t", "u", "line", few, chunk).count() == 0


def test_ranks(spark):
    df = spark.range(2_000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), (F.col("id") * 7919 % 500).alias("t"), "id")
    out = ranked(df, ["k"], ["t", "id"]).collect()
    expected = {}
    for r in sorted(out, key=lambda r: (r.k, r.t, r.id)):
        assert r["_rank"] == expected.setdefault(r.k, 0)
        expected[r.k] += 1


def test_hot_nonce(spark):
    """One nonce with nearly all uses, again and again after its expiry: the same by a fold and by jumps, in chunks."""
    uses = spark.range(6_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("hot").alias("nonce"), F.col("id").alias("line_no"),
        (F.col("id") * MICROS).alias("used_us"), (F.col("id") * MICROS).alias("issued_us"),
        ((F.col("id") + 1 + F.col("id") % 97) * MICROS).alias("expires_us"), F.lit(True).alias("good"))
    audit = lambda **more: {r.line_no: r.use for r in identity.audit_single_use(uses, F.col("good"), F.col("good"), **more).collect()}
    plain = audit()
    until, expected = -1, {}
    for i in range(6_000):
        free = i % 50 == 0 or i >= until
        expected[i] = "accepted" if free else "replayed"
        if free and i % 50:
            until = i + 1 + i % 97
    assert plain == expected and audit(few=100, rows_per_chunk=500) == expected
    assert sum(u == "accepted" for u in audit(for_ever=True).values()) == 121


def test_burst_of_one_stretch(spark):
    """Most events of a key within a second: chunks go by rank, so none holds more than asked for."""
    minutes = F.col("id") * 4 * MINUTE_US
    burst = 40 * MINUTE_US + F.col("id") * 100
    events = spark.range(80).select(minutes.alias("us")).union(spark.range(4_000).select(burst.alias("us"))).select(
        F.lit("session:x").alias("sequence_key"), F.timestamp_micros("us").alias("observed_at"),
        F.monotonically_increasing_id().alias("line_no"), F.lit("account").alias("endpoint_class"))
    events = spark.createDataFrame(events.collect(), events.schema)
    read = lambda c: sorted((r.line_no, r.window_us) for r in windows.sequence_windows(events, c).collect())
    plain = read(windows.WindowConfig())
    assert plain == read(windows.WindowConfig(rows_per_chunk=200))
    us = sorted(r.observed_at.timestamp() * MICROS for r in events.collect())
    start, starts = None, set()
    for t in us:
        if start is None or t >= start + 15 * MINUTE_US:
            start = t
            starts.add(round(t))
    assert {w for _, w in plain} == starts
