"""Session state as ordered computations: epochs, features, response history,
event batches and decoy evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bit, let, micros
from ..functions.timeline import ROWS_PER_CHUNK, Timeline, before, over_timeline, running
from ..vocab import BROWSER_EVENT_KINDS, ENDPOINT_CLASSES, MICROS, MINUTE_US


@dataclass(frozen=True)
class SessionConfig:
    """A session forgets everything once a gap exceeds `ttl_us`."""

    ttl_us: int = 5 * MINUTE_US
    rows_per_chunk: int = ROWS_PER_CHUNK


def add_epochs(df: DataFrame, line: Timeline, ttl_us: int, us: str = "_us") -> DataFrame:
    """Number the uninterrupted stretches of each key (`epoch`, from 1)."""
    df = line.run(df, {"_prev": before("last", F.col(us))})
    new = F.col("_prev").isNull() | (F.col(us) - F.col("_prev") > ttl_us)
    df = df.withColumn("_new", new.cast("int")).drop("_prev")
    return line.run(df, {"epoch": running("sum", F.col("_new"))}).drop("_new")


def add_features(df: DataFrame, line: Timeline) -> DataFrame:
    """Session features within (key, epoch); needs `epoch` and `_us`.

    Only rows that raise the sequence number ("advancing" rows) move the
    endpoint state, so late or replayed rows cannot fake a navigation.
    """
    df = line.run(df, {
        "request_count": running("sum", F.lit(1)),
        "first_seen_us": running("min", F.col("_us")),
        "_prev_seq": before("max", F.col("sequence")),
    }, segment="epoch")
    advancing = F.col("_prev_seq").isNull() | (F.col("sequence") > F.col("_prev_seq"))
    known = F.col("endpoint_class").isin(*ENDPOINT_CLASSES)
    df = df.withColumns({
        "_visited": F.when(advancing & known, F.col("endpoint_class")),
        "_gap": F.when(F.col("sequence") > F.col("_prev_seq"),
                       F.col("sequence") - F.col("_prev_seq") - 1).otherwise(F.lit(0)),
    })
    df = line.run(df, {
        "_from": before("last", F.col("_visited")),
        "_mask": running("bit_or", bit("_visited", ENDPOINT_CLASSES)),
        "max_sequence_gap": running("max", F.col("_gap").cast("long")),
    }, segment="epoch")
    moved = F.coalesce(F.col("_visited") != F.col("_from"), F.lit(False))
    df = df.withColumn("_moved", moved.cast("int"))
    df = line.run(df, {"endpoint_transitions": running("sum", F.col("_moved"))}, segment="epoch")
    return df.withColumn("distinct_endpoint_classes", F.bit_count("_mask")).drop(
        "_prev_seq", "_visited", "_gap", "_from", "_mask", "_moved")


def _ordered(df: DataFrame, config: SessionConfig, apply) -> DataFrame:
    df = df.withColumn("_us", micros("observed_at"))
    out = over_timeline(df, ["session_id"], ["_us", "line_no"], apply, config.rows_per_chunk)
    return out.drop("_us")


def session_epochs(df: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """Requests with their `epoch` (a gap strictly above the TTL starts a new one)."""
    return _ordered(df, config, lambda d, line: add_epochs(d, line, config.ttl_us))


def session_features(df: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """Requests with request_count, first_seen_us, max_sequence_gap,
    distinct_endpoint_classes and endpoint_transitions as known at that request."""
    return _ordered(df, config,
                    lambda d, line: add_features(add_epochs(d, line, config.ttl_us), line))


# --- response history ------------------------------------------------------------

def valid_enforcement(handling: Column, retry: Column) -> Column:
    """Directives that count as an enforcement in the session history."""
    return (F.when(handling == "delay", retry == 1)
            .when(handling == "throttle", retry.between(1, 60))
            .when(handling == "challenge", retry == 0)
            .when(handling == "block", retry.between(1, 3600))
            .otherwise(F.lit(False)))


def retry_until(us: Column, handling: Column, retry: Column, expires_us: Column) -> Column:
    """End of the waiting time a valid directive imposes, NULL without one."""
    until = us + retry.cast("long") * MICROS
    return F.when(valid_enforcement(handling, retry) & (retry > 0), F.least(until, expires_us))


def add_history(df: DataFrame, line: Timeline, handling: Column, retry: Column,
                expires_us: Column) -> DataFrame:
    """`recent_enforcements` before and `premature_retries` up to each request."""
    df = df.withColumns({
        "_until": retry_until(F.col("_us"), handling, retry, expires_us),
        "_enforced": valid_enforcement(handling, retry).cast("int"),
    })
    df = line.run(df, {"_wait": before("max", F.col("_until")),
                       "_recent": before("sum", F.col("_enforced"))}, segment="epoch")
    early = F.coalesce(F.col("_wait") > F.col("_us"), F.lit(False))
    df = df.withColumn("_early", early.cast("int"))
    df = line.run(df, {"_premature": running("sum", F.col("_early"))}, segment="epoch")
    cap = F.lit(255)
    return df.withColumns({
        "recent_enforcements": F.least(F.coalesce("_recent", F.lit(0)), cap).cast("int"),
        "premature_retries": F.least(F.col("_premature"), cap).cast("int"),
    }).drop("_until", "_enforced", "_wait", "_recent", "_early", "_premature")


def enforcement_history(df: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """History columns for rows that already carry a `directive` struct."""
    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        d = add_epochs(d, line, config.ttl_us)
        return add_history(d, line, F.col("directive.handling"),
                           F.col("directive.retry_after_seconds"),
                           micros("directive.expires_at"))
    return _ordered(df, config, apply)


# --- browser event batches -------------------------------------------------------

def valid_batch() -> Column:
    """All-or-nothing contract of a batch."""
    def sound(events: Column) -> Column:
        def ok_event(e: Column) -> Column:
            return ((e.sequence >= 1) & e.kind.isin(*BROWSER_EVENT_KINDS)
                    & e.elapsed_bucket_ms.between(0, 86_400_000) & e.value_bucket.between(0, 65_536))

        following = F.slice(events, 2, F.greatest(F.size(events) - 1, F.lit(0)))
        rising = F.forall(F.zip_with(events, following, lambda a, b: b.isNull() | (b.sequence > a.sequence)),
                          lambda x: x)
        return F.size(events).between(1, 64) & F.forall(events, ok_event) & rising

    return F.coalesce(
        F.octet_length("session_id").between(8, 128) & (F.octet_length("sensor_version") <= 32)
        & let(F.col("events"), sound), F.lit(False))


def ingest_event_batches(df: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """Receipts of valid batches: accepted_events, total_accepted_events, batch_sequence.

    Order within a session is (received_at, line_no). An event counts once its
    sequence exceeds everything the session sent before.
    """
    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        d = add_epochs(d, line, config.ttl_us)
        d = line.run(d, {
            "_seen": before("max", F.array_max(F.transform("events", lambda e: e.sequence))),
            "batch_sequence": running("sum", F.lit(1)),
        }, segment="epoch")
        fresh = F.filter("events", lambda e: e.sequence > F.coalesce(F.col("_seen"), F.lit(0)))
        d = d.withColumn("accepted_events", F.size(fresh)).drop("_seen")
        return line.run(d, {"total_accepted_events": running("sum", F.col("accepted_events"))},
                        segment="epoch")

    df = df.filter(valid_batch()).withColumn("_us", micros("received_at"))
    out = over_timeline(df, ["session_id"], ["_us", "line_no"], apply, config.rows_per_chunk)
    return out.drop("_us")


def verified_event_count(requests: DataFrame, receipts: DataFrame,
                         config: SessionConfig = SessionConfig()) -> DataFrame:
    """As-of join: the latest receipt total at or before each request.

    Zero when there is none or when it is older than the TTL. Both sides are
    stacked on one timeline, so the join is a single shuffle by session.
    """
    left = requests.select(
        "session_id", micros("observed_at").alias("_us"), F.lit(1).alias("_side"),
        F.col("line_no"), F.lit(None).cast("struct<us:bigint,total:bigint>").alias("_receipt"))
    us = micros("received_at")
    right = receipts.select(
        "session_id", us.alias("_us"), F.lit(0).alias("_side"), "line_no",
        F.struct(us.alias("us"), F.col("total_accepted_events").cast("long").alias("total"))
        .alias("_receipt"))

    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        return line.run(d, {"_last": running("last", F.col("_receipt"))})

    out = over_timeline(left.unionByName(right), ["session_id"], ["_us", "_side", "line_no"],
                        apply, config.rows_per_chunk).filter("_side = 1")
    fresh = F.col("_us") - F.col("_last.us") <= config.ttl_us
    return out.select("session_id", "line_no",
                      F.when(fresh, F.col("_last.total")).otherwise(F.lit(0))
                      .alias("verified_event_count"))


# --- decoys ----------------------------------------------------------------------

INTERACTIONS = ("touched", "submitted")
SURFACES = ("link", "form", "api")
MIN_DECOY_TTL_US, MAX_DECOY_TTL_US = MINUTE_US // 2, 15 * MINUTE_US
PENDING_TTL_US = 5 * MINUTE_US
MAX_HITS = 100


def decoy_issue_reason(max_ttl_us: int = MAX_DECOY_TTL_US, min_ttl_us: int = MIN_DECOY_TTL_US) -> Column:
    """Why a capability must not be issued, else NULL: session id, endpoint, surface, lifetime within bounds."""
    ttl = micros("expires_at") - micros("issued_at")
    rules = ((F.octet_length("session_id").between(8, 128), "session_id"), (F.col("endpoint_class").isin(*ENDPOINT_CLASSES), "endpoint_class"),
             (F.col("surface").isin(*SURFACES), "surface"), (ttl.between(min_ttl_us, max_ttl_us), "lifetime"))
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])


def issue_decoys(wanted: DataFrame, max_ttl_us: int = MAX_DECOY_TTL_US, min_ttl_us: int = MIN_DECOY_TTL_US) -> tuple[DataFrame, DataFrame]:
    """(issued, refused with `reason`): only issued capabilities can be redeemed."""
    marked = wanted.withColumn("reason", decoy_issue_reason(max_ttl_us, min_ttl_us))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def redeem_decoys(issued: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit that consumes each capability (at most one per capability).

    A hit counts from the issue (`issued_at`) to before the expiry; `submitted` needs a form
    surface and otherwise leaves the capability usable. The earliest hit is a minimum that
    combines map-side, and the join before it splits a capability that is replayed millions
    of times.
    """
    at = micros("hit_at")
    rules = issued.select("capability", (F.col("surface") == "form").alias("_form"),
                          micros("issued_at").alias("_from"), micros("expires_at").alias("_until"))
    usable = (at >= F.col("_from")) & (at < F.col("_until")) & (F.col("_form") | (F.col("interaction") != "submitted"))
    first = (hits.filter(F.col("interaction").isin(*INTERACTIONS)).join(rules, "capability").filter(usable)
             .groupBy("capability").agg(F.min(F.struct(
                 at.alias("us"), F.col("line_no").alias("line_no"), F.col("interaction").alias("interaction"))).alias("_hit")))
    return (issued.join(first, "capability")
            .select("capability", "session_id", "endpoint_class", "surface",
                    F.timestamp_micros("_hit.us").alias("hit_at"),
                    F.col("_hit.line_no").alias("hit_line_no"),
                    F.col("_hit.interaction").alias("interaction")))


def attach_decoy_hits(requests: DataFrame, redeemed: DataFrame,
                      config: SessionConfig = SessionConfig()) -> DataFrame:
    """Verified hits pending for each request of the same (session, endpoint).

    A request takes all pending hits at once. Hits die together 5 minutes after
    the last one; at most 100 are reported.
    """
    keys = ["session_id", "endpoint_class"]
    left = requests.select(*keys, micros("observed_at").alias("_us"), F.lit(1).alias("_side"),
                           "line_no")
    right = redeemed.select(*keys, micros("hit_at").alias("_us"), F.lit(0).alias("_side"),
                            F.col("hit_line_no").alias("line_no"))

    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        # Between two requests pending hits accumulate until swept; an idle gap of
        # the pending time or more between hits drops the older ones.
        d = line.run(d, {"_turn": before("sum", F.col("_side"))})
        d = d.withColumns({"_turn": F.coalesce("_turn", F.lit(0)),
                           "_hit_us": F.when(F.col("_side") == 0, F.col("_us"))})
        d = line.run(d, {"_prev_hit": before("last", F.col("_hit_us"))}, segment="_turn")
        stale = (F.col("_us") - F.col("_prev_hit") >= PENDING_TTL_US).cast("int")
        d = d.withColumn("_stale", F.coalesce(stale, F.lit(0)))
        d = line.run(d, {"_lapse": running("sum", F.col("_stale"))})
        d = d.withColumn("_stretch", F.col("_turn") + F.col("_lapse"))
        d = d.withColumn("_one", 1 - F.col("_side"))
        return line.run(d, {"_hits": running("sum", F.col("_one"))}, segment="_stretch")

    out = over_timeline(left.unionByName(right), keys, ["_us", "_side", "line_no"], apply,
                        config.rows_per_chunk).filter("_side = 1")
    return out.select("session_id", "line_no",
                      F.least(F.col("_hits"), F.lit(MAX_HITS)).cast("int")
                      .alias("verified_decoy_hits"))
