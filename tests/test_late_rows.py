"""Rows behind the watermark come out tagged; streams run from any folder."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F

from evidentry.operators import session
from evidentry.streaming import jobs, operators as J, ordered
from evidentry.streaming.ordered import LATE

SCHEMA = "session_id string, line_no long, observed_at timestamp, sequence long, endpoint_class string"


def test_on_time_and_late_are_all_rows(spark, tmp_path):
    """Four micro-batches, the third of which brings rows behind the watermark: they are kept, and the others are those of the batch operator."""
    def part(ids, minute):
        return [(f"session-{i % 3}", i, minute(i), i, "account") for i in ids]
    parts = [part(range(0, 30), lambda i: i), part(range(30, 60), lambda i: i), part(range(60, 80), lambda i: i - 58 if i % 4 == 0 else i),
             part(range(80, 100), lambda i: i)]
    flush = [("flush-session", -1, 10**6, 1, "account")]
    as_df = lambda rows: spark.createDataFrame(rows, "session_id string, line_no long, minute long, sequence long, endpoint_class string").select(
        "session_id", "line_no", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("observed_at"), "sequence", "endpoint_class")
    path = str(tmp_path / "in")
    for rows in [*parts, flush, flush]:
        as_df(rows).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    on_time, late = str(tmp_path / "on"), str(tmp_path / "late")
    out = J.stream_session_features(stream, "5 minutes")
    assert out.columns[-2:] == list(LATE)
    query = jobs.write_with_late(out, on_time, late, str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    tardy = {r.late_line_no for r in spark.read.parquet(late).collect()}
    assert tardy == {i for i in range(60, 80) if i % 4 == 0}
    kept = [r for rows in parts for r in rows if r[1] not in tardy]
    cols = list(J.SessionFeatures.outputs)
    read = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert read(spark.read.parquet(on_time).where("line_no >= 0")) == read(session.session_features(as_df(kept)))
    assert {r.line_no for r in spark.read.parquet(on_time).where("line_no >= 0").collect()} | tardy == set(range(100))


def test_many_keys_share_a_buffer_and_a_timer(spark, tmp_path):
    """As many keys as rows, in two micro-batches: the state store holds up to three timers for each slot, none for each key, and no key is mixed with another."""
    count = 8 * ordered.SLOTS
    s = 1_000_000
    uses = spark.range(count).select(
        (F.col("id") % (count // 2)).cast("string").alias("nonce"), F.col("id").alias("line_no"),
        (F.col("id") * s + 1_700_000_000 * s).alias("used_us"), F.lit(2_000_000_000 * s).alias("expires_us"), F.lit(None).cast("string").alias("fault"))
    path, far = str(tmp_path / "in"), 1_900_000_000 * s
    for part in (uses.where(f"line_no < {count // 3}"), uses.where(f"line_no >= {count // 3}"),
                 *[uses.limit(1).withColumns({"nonce": F.lit("end"), "line_no": F.lit(-1).cast("long"), "used_us": F.lit(far)})] * 2):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (J.stream_single_use(stream, F.col("fault"), "0 seconds").writeStream.format("memory").queryName("many_keys")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    timers = [p.stateOperators[0].customMetrics.get("numRegisteredTimers", 0) for p in query.recentProgress if p.stateOperators]
    got = {r.line_no: r.use for r in spark.table("many_keys").where("line_no >= 0").collect()}
    assert got == {i: "accepted" if i < count // 2 else "replayed" for i in range(count)}
    assert 0 < max(timers) <= 3 * ordered.SLOTS


def test_keys_and_values_may_be_null(spark, tmp_path):
    """A NULL key is a key of its own, and whole numbers beside a NULL stay whole."""
    rows = [(None, 1, 10, 7, "account"), ("a", 2, 20, None, None), ("a", 3, 30, 9, "account"), (None, 4, 40, 8, "account"), ("a", 5, None, 1, "account")]
    flush = [("flush-session", -1, 10**6, 1, "account")]
    path = str(tmp_path / "in")
    for part in (rows, flush, flush):
        spark.createDataFrame(part, "session_id string, line_no long, at long, sequence long, endpoint_class string").select(
            "session_id", "line_no", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("observed_at"),
            F.coalesce("sequence", F.lit(3)).alias("sequence"), "endpoint_class").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = (J.stream_session_features(stream, "0 seconds").writeStream.format("memory").queryName("null_keys")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    found = spark.table("null_keys").where("session_id IS NULL OR session_id = 'a'").collect()
    assert sorted((r.line_no, r.session_id, r.request_count, r.max_sequence_gap) for r in found if r.line_no is not None) == [
        (1, None, 1, 0), (2, "a", 1, 0), (3, "a", 2, 5), (4, None, 2, 0)]
    assert [(r.late_line_no, r.late_us) for r in found if r.line_no is None] == [(5, None)]


def test_streams_run_from_any_folder(sf, tmp_path):
    """In a process of its own, whose working folder and search path hold no copy of the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import importlib.util, sys; spec = importlib.util.spec_from_file_location('entry', {repo + '/__spark_entry__.py'!r}); "
            "entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry); from evidentry.session import local_session; "
            f"print('rows', entry.queries()['j6_stream_challenges'](local_session(2, 2), {sf!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "rows" in done.stdout, done.stderr[-3000:]
