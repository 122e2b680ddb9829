"""Operational telemetry: counters, coverage, funnels, posture and latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import count_if, items, micros, optional_class
from ..functions.timeline import ROWS_PER_CHUNK, Timeline, chunked, durable, find_heat, over_timeline, running
from .detect import obs, verified_public_crawler

REASON = r"^[A-Z0-9_]{3,64}$"
COUNTERS = ("protected", "evaluated", "bypassed", "rejected", "granted_retries")
MAX_COUNTER = 2**53 - 1
DISPOSITIONS = ("evaluated", "bypassed", "granted_retry", "rejected")


def state(*rules: tuple[Column, str], otherwise: str) -> Column:
    """First matching state."""
    expr = F.lit(otherwise)
    for cond, name in reversed(rules):
        expr = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(expr)
    return expr


def traffic_counters(d: DataFrame, *keys: str | Column) -> DataFrame:
    """Decisions by enforced and computed action, for optional keys."""
    aggs = [F.count(F.lit(1)).cast("long").alias("decisions")]
    for prefix, column in (("enforced", "action"), ("computed", "computed_action")):
        aggs += [count_if(F.col(column) == a).alias(f"{prefix}_{a}") for a in V.ACTIONS]
    return d.groupBy(*keys).agg(*aggs)


def reason_counters(d: DataFrame, cap: int = 64) -> DataFrame:
    """Decisions per valid reason code (once per decision), the `cap` most frequent."""
    codes = F.array_distinct(F.filter("reason_codes", lambda r: r.rlike(REASON)))
    return (items(d, codes, "code").groupBy("code").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .filter(F.col("code").isNotNull()).orderBy(F.desc("n"), F.asc("code")).limit(cap))


_POSTURE = (("protocol", "transport_protocol", V.TRANSPORT_PROTOCOLS),
            ("security", "transport_security", V.TRANSPORT_SECURITY),
            ("address", "client_address_source", V.ADDRESS_SOURCES))


def transport_posture(requests: DataFrame) -> DataFrame:
    """One row: samples, counts by three vocabularies and a state."""
    aggs = [F.count(F.lit(1)).cast("long").alias("samples")]
    for name, column, values in _POSTURE:
        known = [v for v in values if v != "unknown"]
        c = obs(column)
        aggs += [count_if(c == v).alias(f"{name}_{v}") for v in known]
        aggs.append(count_if(~F.coalesce(c.isin(*known), F.lit(False))).alias(f"{name}_unknown"))
    bad = ("protocol_unknown", "security_plaintext", "security_unknown",
           "address_invalid_trusted_proxy", "address_unknown")
    return requests.agg(*aggs).withColumn("state", state(
        (F.col("samples") == 0, "no_samples"),
        (sum((F.col(b) for b in bad), F.lit(0)) > 0, "attention"), otherwise="collecting"))


def crawler_identity(requests: DataFrame) -> DataFrame:
    """One row: claims by class and verification, qualified or not; rows without claim skipped."""
    cls, ver = optional_class("observations.crawler_class"), optional_class("observations.crawler_verification")
    claimed = F.coalesce(obs("verified_bot"), F.lit(False)) | (cls != "unknown") | (ver != "unknown")
    df = requests.filter(claimed)
    ok = verified_public_crawler()
    aggs = [F.count(F.lit(1)).cast("long").alias("observations"),
            count_if(ok).alias("qualified"), count_if(~ok).alias("unqualified")]
    aggs += [count_if(cls == v).alias(f"class_{v}") for v in V.CRAWLER_CLASSES]
    aggs += [count_if(ver == v).alias(f"verification_{v}") for v in V.CRAWLER_VERIFICATIONS]
    return df.agg(*aggs).withColumn("state", state(
        (F.col("unqualified") > 0, "attention"), (F.col("observations") > 0, "collecting"),
        otherwise="no_samples"))


# --- coverage ------------------------------------------------------------------------------

def valid_coverage_report() -> Column:
    """Contract of one cumulative report (`endpoints`: nine structs in fixed order)."""
    e = F.col("endpoints")
    names = F.transform(e, lambda x: x.endpoint_class) == F.array(*[F.lit(c) for c in V.ENDPOINT_CLASSES])
    counters = F.forall(e, lambda x: (
        F.least(x.protected, x.evaluated, x.bypassed, x.rejected, x.granted_retries) >= 0)
        & (F.greatest(x.protected, x.evaluated, x.bypassed, x.rejected, x.granted_retries) <= MAX_COUNTER)
        & (x.evaluated + x.bypassed + x.rejected + x.granted_retries == x.protected))
    return F.coalesce(
        F.col("source_id").rlike(r"^[0-9a-f]{32}$") & (F.col("sequence") >= 1)
        & (F.col("source_started_at") == F.date_trunc("second", "source_started_at"))
        & (F.col("completed_at") == F.date_trunc("second", "completed_at"))
        & (F.col("completed_at") >= F.col("source_started_at"))
        & (micros("completed_at") <= micros("received_at") + V.MINUTE_US)
        & (F.size(e) == len(V.ENDPOINT_CLASSES)) & names & counters, F.lit(False))


def _fold_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the rows of each (source, chunk), in order, from the state that its first row (`kind` 0) carries.

    The state is the numbers of the last accepted report. Stretches in which every report follows the one before are
    accepted together; after a break the next accepted report is looked for in blocks, so a batch
    costs a pass over its rows and one Python step for each break. At the end of a chunk a row of
    `kind` 1 has its own last accepted report, NULL where it accepted none.
    """
    at, state, own = None, None, None

    def leave() -> list[dict]:
        return [] if at is None else [{"source_id": at[0], "chunk": at[1], "line_no": None, "verdict": None, "kind": 1,
                                       "state": None if own is None else own.tolist()}]

    def judge(valid: np.ndarray, rows: np.ndarray) -> list[str]:
        nonlocal state, own
        out = np.where(valid, "conflict", "invalid").astype(object)
        place = np.flatnonzero(valid)
        x = rows[place]
        n = len(place)
        if not n:
            return out.tolist()
        follows = np.r_[False, _follows(x[:-1], x[1:])]
        breaks = np.r_[np.flatnonzero(~follows), n]
        i = 0
        while i < n:
            if state is None:
                found = i
            else:
                found, size = n, 64
                lo = i
                while lo < n:
                    hits = np.flatnonzero(_follows(state, x[lo:lo + size]))
                    if len(hits):
                        found = lo + int(hits[0])
                        break
                    lo, size = lo + size, size * 2
                same = (x[i:found] == state).all(axis=1)
                out[place[i:found][same]] = "unchanged"
            if found == n:
                break
            end = int(breaks[np.searchsorted(breaks, found, side="right")])
            out[place[found:end]] = "accepted"
            state = own = x[end - 1]
            i = end
        return out.tolist()

    for batch in batches:
        part = {c: batch.column(c).to_pylist() for c in ("source_id", "chunk", "line_no", "kind")}
        valid = np.array(batch.column("valid").to_pylist(), bool)
        numbers = batch.column("numbers")
        key = list(zip(part["source_id"], part["chunk"], strict=True))
        edges = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]] + [len(key)]
        made: list[dict] = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if key[lo] != at:
                made += leave()
                at, state, own = key[lo], None, None
            if part["kind"][lo] == 0:
                given = numbers[lo].as_py()
                state = None if given is None else np.array(given, np.int64)
                lo += 1
            here = np.zeros((hi - lo, _NUMBERS), np.int64)
            good = np.flatnonzero(valid[lo:hi])
            if len(good):
                here[good] = np.array([numbers[int(lo + i)].as_py() for i in good], np.int64) if len(good) < 64 else \
                    np.asarray(numbers.take(pa.array(lo + good)).flatten(), np.int64).reshape(-1, _NUMBERS)
            made += [{"source_id": at[0], "chunk": at[1], "line_no": line, "verdict": v, "kind": 2, "state": None}
                     for line, v in zip(part["line_no"][lo:hi], judge(valid[lo:hi], here), strict=True)]
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_FOLDED)
    if leave():
        yield pa.RecordBatch.from_pylist(leave(), schema=_FOLDED)


#: `protected` is the sum of the others in a valid report, so it is equal, or does not fall, when they are or do not
_KEPT = COUNTERS[1:]
#: start, sequence, completion and the kept counters of all endpoint classes
_NUMBERS = 3 + len(V.ENDPOINT_CLASSES) * len(_KEPT)
_FOLDED = pa.schema([("source_id", pa.string()), ("chunk", pa.int64()), ("line_no", pa.int64()), ("verdict", pa.string()),
                     ("kind", pa.int32()), ("state", pa.list_(pa.int64()))])


def _follows(last: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Same start, higher sequence, no lower completion and counters."""
    return (rows[..., 0] == last[..., 0]) & (rows[..., 1] > last[..., 1]) & (rows[..., 2:] >= last[..., 2:]).all(axis=-1)


REPORTS_PER_TASK = 1_000_000


def accept_coverage(reports: DataFrame, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Add `verdict`: invalid, accepted, unchanged (identical resend) or conflict.

    A report must follow the last *accepted* report of its source: same start, rising
    sequence, no decreasing time or counter. That is a fold along the reports of a source, whose state is one report;
    a task reads its rows in order as a stream and holds one batch.

    A source of more than `rows_per_chunk` reports is cut by rank into chunks. Each is folded from a guess of the
    state before it: the last report that an earlier chunk accepts of its own. Chunks whose guess was wrong are
    folded again, all at the same time, until no guess changes. Every round settles one more chunk at least, and one
    that accepts nothing hands on what came before it, so counters that fall once settle in the third round however many
    reports follow. Chunks are numbered and dealt evenly, so that a task has one chunk, or chunks of at most
    `REPORTS_PER_TASK` reports together once there are more than shuffle partitions hold. `line_no` names a report within its source.
    """
    keys = ["source_id"]
    numbers = F.concat(
        F.array(F.unix_micros("source_started_at"), F.col("sequence").cast("long"), F.unix_micros("completed_at")),
        F.flatten(F.transform("endpoints", lambda x: F.array(*[x[c].cast("long") for c in _KEPT]))))
    valid = valid_coverage_report()
    rows = reports.select("source_id", micros("received_at").alias("_us"), F.col("line_no").cast("long").alias("line_no"),
                          valid.alias("valid"), F.when(valid, numbers).alias("numbers"))
    heat = find_heat(rows, keys, rows_per_chunk)
    ddl = "source_id string, chunk long, line_no long, verdict string, kind int, state array<long>"

    def folded(part: DataFrame, guesses: DataFrame | None, slots: DataFrame | None = None, tasks: int = 0) -> DataFrame:
        part = part.select("source_id", "chunk", "_us", "line_no", "valid", "numbers", F.lit(2).alias("kind"))
        if guesses is not None:
            part = part.unionByName(guesses.select(
                "source_id", "chunk", F.lit(None).cast("long").alias("_us"), F.lit(None).cast("long").alias("line_no"),
                F.lit(False).alias("valid"), F.col("guess").alias("numbers"), F.lit(0).alias("kind")))
        if slots is None:
            dealt = part.repartition("source_id", "chunk")
        else:
            dealt = part.join(F.broadcast(slots), ["source_id", "chunk"]).repartitionById(tasks, "slot").drop("slot")
        return dealt.sortWithinPartitions("source_id", "chunk", "kind", "_us", "line_no").drop("_us").mapInArrow(_fold_reports, ddl)

    cold = rows if heat is None else rows.join(F.broadcast(heat.keys), keys, "left_anti")
    found = folded(cold.withColumn("chunk", F.lit(0).cast("long")), None).filter("kind = 2")
    if heat is not None:
        hot = chunked(rows.join(F.broadcast(heat.keys), keys, "left_semi"), keys, ["_us", "line_no"], heat.rows_per_chunk)
        hot = durable(hot.withColumnRenamed("_chunk", "chunk"))
        found = found.unionByName(_settled(hot, folded, heat.rows_per_chunk))
    return reports.join(found.select("source_id", "line_no", "verdict"), [*keys, "line_no"])


def _slots(rows: DataFrame, rows_per_chunk: int) -> tuple[DataFrame, int]:
    """Every chunk with its number (`slot`), and how many tasks the numbers are dealt to in turn."""
    at = ["source_id", "chunk"]
    # one row a chunk
    slots = durable(rows.select(*at).distinct().withColumn("slot", F.row_number().over(Window.orderBy(*at)) - 1))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slots, max(partitions, -(-slots.count() * rows_per_chunk // REPORTS_PER_TASK))


def _settled(rows: DataFrame, folded: Callable[..., DataFrame], rows_per_chunk: int) -> DataFrame:
    """Folded chunks whose guesses are right; one row per chunk decides about the next round."""
    at = ["source_id", "chunk"]
    earlier = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    dealt = _slots(rows, rows_per_chunk)
    now = durable(folded(rows, None, *dealt))
    used = durable(dealt[0].select(*at, F.lit(None).cast("array<long>").alias("guess")))
    while True:
        ends = now.filter("kind = 1").select(*at, "state")
        # at most one row for every `rows_per_chunk` reports
        guess = ends.withColumn("guess", F.last("state", ignorenulls=True).over(earlier)).select(*at, "guess")
        wrong = durable(guess.alias("g").join(used.alias("u"), at).filter(~F.col("g.guess").eqNullSafe(F.col("u.guess"))).select(*at, "g.guess"))
        if wrong.isEmpty():
            return now.filter("kind = 2")
        these = F.broadcast(wrong.select(*at))
        again = folded(rows.join(these, at, "left_semi"), wrong, *dealt)
        now = durable(now.join(these, at, "left_anti").unionByName(again))
        used = durable(used.join(wrong.select(*at), at, "left_anti").unionByName(wrong))


def origin_coverage(accepted: DataFrame, observer_start: Column) -> DataFrame:
    """Per endpoint: latest minus baseline, summed over sources.

    The baseline of a source that began before the observer is its first report.
    """
    ok = accepted.filter("verdict = 'accepted'")
    state_row = F.struct("source_started_at", "endpoints")
    s = ok.groupBy("source_id").agg(F.max_by(state_row, "sequence").alias("_new"),
                                    F.min_by("endpoints", "sequence").alias("_first"))
    early = F.col("_new.source_started_at") < observer_start
    delta = F.zip_with(F.col("_new.endpoints"), F.col("_first"), lambda a, b: F.struct(
        a.endpoint_class.alias("endpoint_class"),
        *[(a[c] - F.when(early, b[c]).otherwise(0)).alias(c) for c in COUNTERS]))
    return (s.select(F.inline(delta)).groupBy("endpoint_class")
            .agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS]))


def coverage_state(coverage: DataFrame, sources: DataFrame, observer_start: Column) -> DataFrame:
    """One row: totals, sources, time range, decision coverage and state.

    A source is observed since it or the observer started, whichever is later.
    """
    one = coverage.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    newest = sources.filter("verdict = 'accepted'").groupBy("source_id").agg(
        F.max_by(F.struct(micros("source_started_at").alias("started"), micros("completed_at").alias("done")),
                 "sequence").alias("_r"))
    n = newest.agg(
        F.count(F.lit(1)).cast("long").alias("sources"), F.max("_r.done").alias("last_reported_us"),
        F.min(F.greatest(F.col("_r.started"), micros(observer_start))).alias("observed_since_us"))
    total = F.col("protected")
    share = (F.col("evaluated") + F.col("granted_retries")).cast("double") / F.when(total > 0, total).otherwise(1)
    return one.crossJoin(F.broadcast(n)).withColumns({
        "decision_coverage": F.when(total > 0, F.least(F.lit(1.0), share)).otherwise(0.0),
        "state": state((F.col("bypassed") + F.col("rejected") > 0, "degraded"),
                       (total > 0, "collecting"), (F.col("sources") > 0, "no_samples"),
                       otherwise="unavailable")})


def request_dispositions(log: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Cumulative counters per (keys, endpoint) from request rows; unknown endpoint -> other."""
    e = F.col("endpoint_class")
    e = F.when(F.coalesce(e.isin(*V.ENDPOINT_CLASSES), F.lit(False)), e).otherwise(F.lit("other"))
    d = F.col("disposition")
    known = F.coalesce(d.isin("evaluated", "bypassed", "granted_retry"), F.lit(False))
    return log.groupBy(*keys, e.alias("endpoint_class")).agg(
        F.count(F.lit(1)).cast("long").alias("protected"),
        count_if(d == "evaluated").alias("evaluated"), count_if(d == "bypassed").alias("bypassed"),
        count_if(~known).alias("rejected"), count_if(d == "granted_retry").alias("granted_retries"))


def running_dispositions(log: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Cumulative counters of a request's (source, endpoint) right after it."""
    e = F.col("endpoint_class")
    e = F.when(F.coalesce(e.isin(*V.ENDPOINT_CLASSES), F.lit(False)), e).otherwise(F.lit("other"))
    d = F.col("disposition")
    known = F.coalesce(d.isin("evaluated", "bypassed", "granted_retry"), F.lit(False))
    one = lambda c: running("sum", F.coalesce(c, F.lit(False)).cast("int"))

    def apply(f: DataFrame, line: Timeline) -> DataFrame:
        return line.run(f, {"protected": running("sum", F.lit(1)), "evaluated": one(d == "evaluated"),
                            "bypassed": one(d == "bypassed"), "rejected": one(~known),
                            "granted_retries": one(d == "granted_retry")})

    df = log.withColumns({"endpoint_class": e, "_us": micros("observed_at")})
    return over_timeline(df, ["source_id", "endpoint_class"], ["_us", "line_no"], apply,
                         rows_per_chunk).drop("_us")


# --- flows ---------------------------------------------------------------------------------

def collection_funnel(steps: DataFrame, enabled: bool = True) -> DataFrame:
    """One row from (stage) rows: proof, batch, recorded, rejected, dropped."""
    stages = {"proof": "context_proofs", "batch": "accepted_batches", "recorded": "recorded_decisions",
              "rejected": "rejected_before_ingest", "dropped": "dropped_after_ingest"}
    one = steps.agg(*[count_if(F.col("stage") == k).alias(v) for k, v in stages.items()])
    n = F.col("accepted_batches")
    share = F.col("recorded_decisions").cast("double") / F.when(n > 0, n).otherwise(1)
    bad = F.col("rejected_before_ingest") + F.col("dropped_after_ingest") > 0
    return one.withColumns({
        "batch_recording_rate": F.when(n > 0, F.least(F.lit(1.0), share)).otherwise(0.0),
        "state": state((F.lit(not enabled), "disabled"), (bad, "degraded"), (n > 0, "collecting"),
                       otherwise="no_samples")})


def outcome_flow(results: DataFrame, enabled: bool = True) -> DataFrame:
    """One row from (result) rows: accepted, rejected, dropped."""
    one = results.agg(*[count_if(F.col("result") == r).alias(r) for r in ("accepted", "rejected", "dropped")])
    return one.withColumn("state", state(
        (F.lit(not enabled), "disabled"), (F.col("rejected") + F.col("dropped") > 0, "degraded"),
        (F.col("accepted") > 0, "collecting"), otherwise="no_samples"))


# --- latency -------------------------------------------------------------------------------

def nearest_rank(df: DataFrame, column: str, percents: Sequence[int] = (50, 95, 99),
                 keys: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """Exact nearest-rank percentiles of an integer column, plus n and max.

    Equal values collapse to one counted row, and ranks are prefix sums in two levels
    (ranges of `width` values, values in a range): no task sees all values of a key.
    """
    keys = list(keys)
    v = F.col(column)
    counts = df.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_b", F.floor(F.col("_v") / float(width)))
    per = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per = per.select(*keys, "_b", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_base"),
                     F.sum("_t").over(whole).alias("_n"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = counts.join(per, [*keys, "_b"]).withColumn("_upto", F.col("_base") + F.sum("_c").over(inside))
    rank = lambda p: F.greatest(F.ceil(F.col("_n") * p / 100.0), F.lit(1))
    return ranked.groupBy(*keys).agg(
        F.max("_n").cast("long").alias("n"),
        *[F.min(F.when(F.col("_upto") >= rank(p), F.col("_v"))).cast("long").alias(f"p{p}") for p in percents],
        F.max("_v").cast("long").alias("max"))


def latency_summary(df: DataFrame, latency_us: str = "latency_us", time: str = "observed_at",
                    failure: str = "failure_class") -> DataFrame:
    """One row: nearest-rank percentiles, failures and throughput per second."""
    us = micros(time)
    ranks = nearest_rank(df, latency_us)
    flow = df.agg(count_if(F.coalesce(F.col(failure), F.lit("")) != "").alias("failures"),
                  (F.max(us) - F.min(us)).alias("elapsed_us"))
    seconds = F.col("elapsed_us") / float(V.MICROS)
    return ranks.crossJoin(F.broadcast(flow)).withColumn(
        "throughput", F.when(F.col("elapsed_us") > 0, F.col("n") / F.when(F.col("elapsed_us") > 0, seconds)
                             .otherwise(1.0)).otherwise(0.0))


def failure_counts(df: DataFrame, failure: str = "failure_class") -> DataFrame:
    return (df.filter(F.coalesce(F.col(failure), F.lit("")) != "")
            .groupBy(F.col(failure).alias("failure_class")).agg(F.count(F.lit(1)).cast("long").alias("n")))


def run_spread(runs: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Median, minimum and maximum of a metric over repeated runs (few rows per key)."""
    return runs.groupBy(*keys).agg(F.median(metric).alias("median"), F.min(metric).alias("minimum"),
                                   F.max(metric).alias("maximum"))
