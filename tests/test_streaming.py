"""Stream output must equal the batch operator on the same finite input."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentry.functions.expr import micros
from evidentry.operators import challenge, identity, session, telemetry, windows
from evidentry.plans import derived as T
from evidentry.streaming import jobs, operators as J

LAST = "timestamp'2030-01-01 00:00:00'"


def feed(spark, df, tmp_path, name, order, flush, files=3):
    """Write rows as several files in time order, plus a flush row far in the future."""
    path = str(tmp_path / name)
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // files)
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]
    for part in parts + [[flush(rows[1].asDict(recursive=True))]] * 2:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, tmp_path, name, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"cp-{name}")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def future(**changes):
    import datetime as dt

    at = dt.datetime(2030, 1, 1)

    def make(row):
        row.update({k: (at if v is None else v) for k, v in changes.items()})
        return row
    return make


def test_session_features(spark, sf, tmp_path):
    df = T.requests(spark, sf)
    stream = feed(spark, df, tmp_path, "req", "observed_at", future(observed_at=None, line_no=-1, session_id="flush"))
    got = drain(spark, J.stream_session_features(stream, "1 minute"), tmp_path, "t_features")
    cols = J.SessionFeatures.outputs
    assert rows(got.filter("session_id <> 'flush'"), cols) == rows(session.session_features(df), cols)


def test_event_batches(spark, sf, tmp_path):
    df = T.event_batches(spark, sf)
    stream = feed(spark, df, tmp_path, "bat", "received_at", future(received_at=None, line_no=-1, session_id="flushflush"))
    got = drain(spark, J.stream_event_batches(stream, "1 minute"), tmp_path, "t_batches")
    cols = J.BatchReceipts.outputs
    assert rows(got.filter("line_no >= 0"), cols) == rows(session.ingest_event_batches(df), cols)


def test_windows(spark, sf, tmp_path):
    df = T.local_events(spark, sf)
    stream = feed(spark, df, tmp_path, "loc", "observed_at",
                  future(observed_at=None, line_no=-1, subject_id="flush", session_id="flush"))
    got = drain(spark, J.stream_windows(stream, "400 minutes"), tmp_path, "t_windows")
    cols = ["sequence_key", "first_us", "last_us", "events", "peak_minute", "transitions", "automation",
            "abuse_intent", "decoy", "challenge_flags"]
    batch = windows.windows_of(df)
    assert rows(got, cols) == rows(batch, cols)
    reasons = rows(batch.withColumn("closure", F.when(F.col("closure") == "end_of_input", "inactivity")
                                    .otherwise(F.col("closure"))), ["sequence_key", "first_us", "closure"])
    assert rows(got, ["sequence_key", "first_us", "closure"]) == reasons


def test_challenges(spark, sf, tmp_path):
    issued, events = T.challenges(spark, sf)
    first = issued.select("challenge_id", (F.col("ready_us") - 2_000_000).alias("us"),
                          F.lit(-1).cast("long").alias("line_no"), F.lit("issue").alias("kind"),
                          F.lit(True).alias("ok"), "ready_us", "expires_us")
    rest = events.withColumns({"ready_us": F.lit(0).cast("long"), "expires_us": F.lit(0).cast("long")})
    df = first.unionByName(rest.select(*first.columns)).withColumn("event_time", F.timestamp_micros("us"))
    stream = feed(spark, df, tmp_path, "cha", "event_time",
                  future(event_time=None, challenge_id="flush", kind="verify", us=1893456000000000))
    got = drain(spark, J.stream_challenges(stream, "10 minutes"), tmp_path, "t_challenges")
    assert rows(got, ["challenge_id", "outcome"]) == rows(
        challenge.challenge_lifecycle(issued, events), ["challenge_id", "outcome"])


def test_coverage(spark, sf, tmp_path):
    df = T.coverage_reports(spark, sf)
    stream = feed(spark, df, tmp_path, "cov", "received_at", future(received_at=None, line_no=-1, source_id="f" * 32))
    got = drain(spark, J.stream_coverage(stream, "1 minute"), tmp_path, "t_coverage")
    cols = ["source_id", "line_no", "verdict"]
    assert rows(got.filter("line_no >= 0"), cols) == rows(telemetry.accept_coverage(df), cols)


def test_single_use(spark, sf, tmp_path):
    signed = F.col("signature") == identity.signature("payload", T.LOG_KEY)
    df = T.proofs(spark, sf).withColumn("at", F.timestamp_micros("used_us"))
    stream = feed(spark, df, tmp_path, "use", "at", future(at=None, nonce="flush", line_no=-1, used_us=1893456000000000,
                                                          expires_us=1893456600000000, issued_us=1893455900000000))
    fault = identity.proof_fault(F.col("well_formed"), signed)
    got = drain(spark, J.stream_single_use(stream, fault, "1 minute"), tmp_path, "t_use")
    want = identity.audit_single_use(df, F.col("well_formed"), signed)
    assert rows(got.filter("line_no >= 0"), ["line_no", "use"]) == rows(want, ["line_no", "use"])
    assert {r["use"] for r in want.select("use").distinct().collect()} >= {"accepted", "replayed", "expired"}


def test_nonce_is_free_after_its_expiry(spark):
    s = 1_000_000
    uses = spark.createDataFrame(
        [(1, "n", 0, 10 * s, 1 * s), (2, "n", 0, 10 * s, 5 * s), (3, "n", 15 * s, 30 * s, 21 * s), (4, "n", 15 * s, 30 * s, 22 * s),
         (5, "m", 0, 300 * s, 2 * s), (6, None, 0, 300 * s, 2 * s), (7, "m", 0, 300 * s, 2 * s)],
        "line_no long, nonce string, issued_us long, expires_us long, used_us long")
    use = lambda **kw: {r["line_no"]: r["use"] for r in identity.audit_single_use(
        uses, F.lit(True), F.lit(True), **kw).collect()}
    freed = {1: "accepted", 2: "replayed", 3: "accepted", 4: "replayed", 5: "accepted", 6: "malformed", 7: "replayed"}
    assert use() == freed
    assert use(for_ever=True) == {**freed, 3: "replayed"}


def test_proof_claims(spark):
    base = {"version": 1, "session_id": "session-1", "expected_session": "session-1", "action": "a", "expected_action": "a",
            "nonce": "A" * 22, "issued_us": 0, "expires_us": 300_000_000, "request_action": None, "endpoint_class": None}
    cases = [({}, True), ({"version": 2}, False), ({"nonce": "A" * 21}, False), ({"expires_us": 300_000_001}, False),
             ({"expires_us": 0}, False), ({"expected_action": "b"}, False), ({"expected_session": "other-one"}, False),
             ({"request_action": "x"}, False), ({"request_action": "x", "endpoint_class": "y"}, True), ({"session_id": None}, False)]
    schema = ("version int, session_id string, expected_session string, action string, expected_action string, nonce string, "
              "issued_us long, expires_us long, request_action string, endpoint_class string")
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], schema)
    assert [r[0] for r in df.select(identity.valid_claims()).collect()] == [ok for _, ok in cases]


def test_link_outcomes(spark, sf, tmp_path):
    d = T.logged(spark, sf).select("decision_id", "recorded_at", "endpoint_class").dropDuplicates(["decision_id"])
    o = T.outcomes(T.logged(spark, sf)).filter("decision_id IS NOT NULL")
    ds = feed(spark, d, tmp_path, "dec", "recorded_at", future(recorded_at=None, decision_id="flush"), files=1)
    os = feed(spark, o, tmp_path, "out", "recorded_at", future(recorded_at=None, decision_id="flush-o"), files=1)
    got = drain(spark, J.stream_link_outcomes(ds, os), tmp_path, "t_link").filter("decision_id <> 'flush'")
    right = o.select(F.col("decision_id").alias("i"), "outcome")
    want = d.join(right, d.decision_id == right.i, "left")
    assert rows(got, ["decision_id", F.coalesce("outcome", F.lit(""))]) == rows(
        want, ["decision_id", F.coalesce("outcome", F.lit(""))])


def test_counters(spark, sf, tmp_path):
    d = T.logged(spark, sf).select("recorded_at", "action", "computed_action")
    stream = feed(spark, d, tmp_path, "cnt", "recorded_at", future(recorded_at=None))
    got = drain(spark, J.stream_counters(stream, "5 minutes", "400 minutes"), tmp_path, "t_counters", "update")
    assert got.groupBy("window").agg(F.max("decisions").alias("n")).filter(
        f"window.start < {LAST}").agg(F.sum("n")).first()[0] == d.count()


def test_watch_report(spark, sf, tmp_path):
    from evidentry.sources.reports import read_latest_report

    d = T.logged(spark, sf).select("recorded_at", "action", "computed_action", "mode")
    table = str(tmp_path / "table")
    d.write.parquet(table)
    from evidentry.operators.analysis import decision_summary
    stream = spark.readStream.schema(d.schema).parquet(table)
    for _ in range(2):
        q = jobs.watch_report(stream, table, decision_summary, str(tmp_path / "report"), str(tmp_path / "cp"),
                              available_now=True)
        q.awaitTermination(60)
        d.limit(10).write.mode("append").parquet(table)
    report = read_latest_report(spark, str(tmp_path / "report")).first()
    assert report["decisions"] == d.count() + 10


def test_route_late(spark, sf, tmp_path):
    d = T.requests(spark, sf).select("observed_at", "line_no").orderBy("line_no")
    path, all_rows = str(tmp_path / "in"), d.collect()
    half = len(all_rows) // 2
    for part in (all_rows[half:], all_rows[:half]):  # the older half arrives second
        spark.createDataFrame(part, d.schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(d.schema).parquet(path)
        q = jobs.route_late(stream, "observed_at", 0, str(tmp_path / "ok"), str(tmp_path / "late"),
                            str(tmp_path / "cp"), available_now=True)
        q.awaitTermination(60)
    ok, late = (spark.read.parquet(str(tmp_path / n)) for n in ("ok", "late"))
    assert ok.count() + late.count() == len(all_rows)
    assert late.count() == half
    assert late.agg(F.max(micros("observed_at"))).first()[0] < ok.agg(F.max(micros("observed_at"))).first()[0]


def test_registered_streams_have_the_columns_of_their_sql(spark, sf):
    """Streams whose query returns all outputs: columns and rows are those of the SQL."""
    from compare import compare, duck
    from evidentry.plans import catalog, oracle

    con = duck(sf)
    for name in ("j1_stream_session_features", "j8_stream_coverage"):
        problem = compare(spark, con, name, catalog.QUERIES[name], oracle.sql(oracle.QUERIES[name]), sf)
        assert problem is None, (name, problem)
