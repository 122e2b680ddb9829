"""The chunked path for hot keys must give exactly the rows of the plain path."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evidentry.functions.timeline import Timeline, before, chunked, find_heat, over_timeline, running
from evidentry.operators import challenge, decide, identity, session, telemetry, windows
from evidentry.plans import derived as T
from evidentry.vocab import MINUTE_US

TINY = 17


def rows(df, columns=None):
    df = df.select(*sorted(columns or df.columns))
    return sorted(map(repr, df.collect()))


def same(plain, chunked, columns=None):
    a, b = rows(plain, columns), rows(chunked, columns)
    assert a and a == b


def test_heat_finds_only_hot_keys(spark):
    df = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("k"),
                                  F.col("id").alias("t"))
    assert [r.k for r in find_heat(df, ["k"], 50).keys.collect()] == [0]
    assert find_heat(df, ["k"], 1000) is None


@pytest.mark.parametrize("time", ["id", "id DIV 400 * 1000000", "0L", "CASE WHEN id < 2970 THEN id % 7 ELSE id * 1000000 END"])
def test_chunks_are_bounded(spark, time):
    """Even, stepped, equal and bursty times: no chunk has more rows than asked for."""
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.expr(time).alias("t"), F.col("id").alias("line"))
    cut = chunked(df, ["k"], ["t", "line"], 100)
    sizes = cut.groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.min(F.struct("t", "line")).alias("lo"),
                                           F.max(F.struct("t", "line")).alias("hi")).orderBy("k", "_chunk").collect()
    assert max(r.n for r in sizes) == 100 and len(sizes) == 30 and sum(r.n for r in sizes) == 3000
    assert all(x.hi < y.lo for x, y in zip(sizes, sizes[1:]) if x.k == y.k)
    # rows that are equal in every column of the order still spread
    same_rows = chunked(df.withColumns({"t": F.lit(0), "line": F.lit(0)}), ["k"], ["t", "line"], 100)
    assert same_rows.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] == 100


@pytest.mark.parametrize("kind", ["sum", "max", "min", "bit_or", "last", "first"])
@pytest.mark.parametrize("segment", [None, "seg"])
def test_every_running_kind(spark, kind, segment):
    df = spark.range(400).select(
        (F.col("id") % 2).alias("k"), F.col("id").alias("t"),
        F.floor(F.col("id") / 90).cast("int").alias("seg"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).alias("v"))
    specs = {"a": running(kind, F.col("v")), "b": before(kind, F.col("v"))}

    def apply(d, line: Timeline):
        return line.run(d, specs, segment)

    same(over_timeline(df, ["k"], ["t"], apply), over_timeline(df, ["k"], ["t"], apply, 23))


def test_sessions(spark, sf):
    hot = session.SessionConfig(rows_per_chunk=TINY)
    df = T.requests(spark, sf)
    same(session.session_features(df).drop("observations"), session.session_features(df, hot).drop("observations"))


def test_decisions_with_feedback(spark, sf):
    df = T.requests(spark, sf)
    config = decide.DecisionConfig(plan=T.rollout_plan(), cohort_key=T.LOG_KEY)
    hot = replace(config, session=session.SessionConfig(rows_per_chunk=TINY))
    cols = ["line_no", "action", "reason_codes", "directive", "recent_enforcements", "premature_retries"]
    same(decide.decide(df, config), decide.decide(df, hot), cols)


def test_batches_and_receipts(spark, sf):
    hot = session.SessionConfig(rows_per_chunk=TINY)
    b = T.event_batches(spark, sf)
    plain, chunked = session.ingest_event_batches(b), session.ingest_event_batches(b, hot)
    cols = ["line_no", "accepted_events", "total_accepted_events", "batch_sequence"]
    same(plain, chunked, cols)
    r = T.requests(spark, sf)
    same(session.verified_event_count(r, plain), session.verified_event_count(r, plain, hot))


def test_decoys(spark, sf):
    hot = session.SessionConfig(rows_per_chunk=3)
    redeemed = session.redeem_decoys(T.decoy_issued(spark, sf), T.decoy_hits(spark, sf))
    r = T.requests(spark, sf)
    same(session.attach_decoy_hits(r, redeemed), session.attach_decoy_hits(r, redeemed, hot))


def test_windows(spark, sf):
    df = T.local_events(spark, sf)
    hot = windows.WindowConfig(rows_per_chunk=TINY, slice_us=20 * MINUTE_US)
    same(windows.windows_of(df), windows.windows_of(df, hot))


def test_one_endless_stretch(spark):
    """A key that never pauses for two days, cut into slices and composed again."""
    df = spark.range(3000).select(
        F.col("id").alias("line_no"),
        F.timestamp_micros(F.lit(T.T0) + F.col("id") * 57_000_000 + F.col("id") * F.col("id") % 1000 * 1000)
        .alias("observed_at"), F.lit("one").alias("sequence_key"), F.lit("api").alias("endpoint_class"))
    hot = windows.WindowConfig(rows_per_chunk=100, slice_us=25 * MINUTE_US)
    plain = windows.sequence_windows(df)
    assert plain.select("window_us").distinct().count() > 100
    same(plain, windows.sequence_windows(df, hot), ["line_no", "window_us"])


def test_challenges_and_liveness(spark, sf):
    same(challenge.challenge_lifecycle(*T.challenges(spark, sf)),
         challenge.challenge_lifecycle(*T.challenges(spark, sf), rows_per_chunk=3))
    same(challenge.liveness_attempts(*T.liveness(spark, sf)),
         challenge.liveness_attempts(*T.liveness(spark, sf), rows_per_chunk=2))


def test_revisions_and_coverage(spark, sf):
    same(identity.monotone_revisions(T.revisions(spark, sf), "document"),
         identity.monotone_revisions(T.revisions(spark, sf), "document", rows_per_chunk=TINY))
    df = T.coverage_reports(spark, sf)
    same(telemetry.accept_coverage(df), telemetry.accept_coverage(df, rows_per_chunk=TINY),
         ["source_id", "line_no", "verdict"])
    log = T.request_log(spark, sf)
    same(telemetry.running_dispositions(log), telemetry.running_dispositions(log, TINY))


def test_trust_lists_and_peak(spark, sf):
    tables = T.trust_tables(spark, sf)
    cols = ["line_no", "trusted", "maximum_assurance_level", "uniqueness_scope"]
    same(identity.issuer_trust(*tables), identity.issuer_trust(*tables, rows_per_chunk=37), cols)
    # one instant with many openings and closings
    w = spark.range(500).select((F.col("id") % 3).alias("first_us"), (F.col("id") % 3 + 1 + F.col("id") % 2).alias("closed_us"))
    level, best = 0, 0
    rows_ = [(r["first_us"], r["closed_us"]) for r in w.collect()]
    for t in range(6):
        level += sum(a == t for a, _ in rows_) - sum(b == t for _, b in rows_)
        best = max(best, level)
    assert windows.peak_active(w).first()[0] == best
    assert windows.peak_active(w.limit(0)).first()[0] == 0
