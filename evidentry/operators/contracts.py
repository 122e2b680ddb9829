"""Contracts of the evidence tables: validation, order, budgets, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import (count_if, first_reason, in_or_absent, is_finite, micros,
                              optional_class)
from ..functions.timeline import open_files

LOCAL_INPUT_VERSION = "evidentry.local-input.v1"
LOG_VERSIONS = ("evidentry.log.v1", "evidentry.log.v2", "evidentry.log.v3", "evidentry.log.v4")
UTC_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
EDGE_SPACE = r"^[\s\u0085   -     　]|" \
             r"[\s\u0085   -     　]$"


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with `reason`)."""
    marked = df.withColumn("reason", reason)
    return (marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL"))


# --- local evidence ----------------------------------------------------------------

def valid_reference(c: Column | str) -> Column:
    """1..512 bytes, trimmed, no control characters, valid UTF-8."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.octet_length(c).between(1, 512) & ~c.rlike(EDGE_SPACE) & ~c.rlike(CONTROL)
            & F.is_valid_utf8(c))


def valid_utc_text(c: Column | str) -> Column:
    """RFC 3339 with a `Z` suffix, and a real calendar time."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(UTC_TIME) & F.try_to_timestamp(F.substring(c, 1, 19),
                                                  F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()


def evidence_reason(version: str = LOCAL_INPUT_VERSION) -> Column:
    """Why a local evidence row (text `observed_at`) breaks its contract, else NULL.

    `version` is the schema version its producer writes.
    """
    e, label = "evidence.", "label."
    closed = (F.col("source").isin(*V.LOCAL_SOURCES)
              & F.col("endpoint_class").isin(*V.LOCAL_ENDPOINTS)
              & F.col("action_class").isin(*V.LOCAL_ACTIONS)
              & F.col("status_class").isin(*V.STATUS_CLASSES)
              & F.col(e + "collection_status").isin(*V.COLLECTION_STATES)
              & F.col(e + "automation_evidence").isin(*V.LEVELS)
              & F.col(e + "abuse_intent_evidence").isin(*V.LEVELS)
              & F.col(e + "continuity_evidence").isin(*V.LEVELS)
              & F.col(e + "decoy_interaction").isin(*V.DECOY_LEVELS)
              & F.col(e + "challenge_lifecycle").isin(*V.CHALLENGE_STATES))
    label_closed = (F.col(label + "class").isin(*V.LABEL_CLASSES)
                    & F.col(label + "provenance").isin(*V.LABEL_PROVENANCES)
                    & F.col(label + "confidence").isin(*V.LABEL_CONFIDENCES))
    triple = F.concat_ws("|", label + "class", label + "provenance", label + "confidence")
    no_session = F.coalesce(F.col("session_ref"), F.lit("")) == ""
    return first_reason(
        (F.col("schema_version") == version, "schema_version"),
        (valid_reference("subject_ref") & (no_session | valid_reference("session_ref")), "reference"),
        (closed, "closed_enum"),
        (label_closed, "label_enum"),
        (triple.isin(*["|".join(t) for t in V.LABEL_TRIPLES]), "label_pairing"),
        (valid_utc_text("observed_at"), "observed_at"))


def validate_evidence(df: DataFrame, version: str = LOCAL_INPUT_VERSION) -> tuple[DataFrame, DataFrame]:
    """(valid rows with a timestamp `observed_at`, quarantine with `reason`)."""
    valid, bad = split_valid(df, evidence_reason(version))
    return valid.withColumn("observed_at", F.col("observed_at").cast("timestamp")), bad


# --- chronology --------------------------------------------------------------------

def check_chronology(df: DataFrame, time: str, line: str, source: str | None = None,
                     block: int = 1_000_000) -> DataFrame:
    """Rows whose time is earlier than the row before them in input order.

    Input order is (`source`, `line`). Lines are compared inside blocks of `block`
    lines, and then the first row of each block with the last row of the block
    before it, so no task ever holds a whole source.
    """
    src = F.col(source) if source else F.lit("")
    df = df.withColumns({"_src": src, "_blk": F.floor(F.col(line) / float(block)),
                         "_us": micros(time)})
    inside = Window.partitionBy("_src", "_blk").orderBy(line)
    local = df.withColumn("_before", F.lag("_us").over(inside))
    late_inside = local.filter(F.col("_us") < F.col("_before"))
    edges = df.groupBy("_src", "_blk").agg(
        F.min_by("_us", line).alias("_first"), F.max_by("_us", line).alias("_last"),
        F.min(line).alias("_line"))
    # Block edges are one row per million lines; the source order is theirs too.
    across = Window.orderBy("_src", "_blk")
    broken = (edges.withColumn("_before", F.lag("_last").over(across))
              .filter(F.col("_first") < F.col("_before"))
              .select("_src", F.col("_line").alias(line), F.col("_before")))
    late_edges = df.join(broken, ["_src", line])
    columns = [F.col(line), F.col("_us").alias("observed_us"), F.col("_before").alias("previous_us")]
    if source:
        columns.insert(0, F.col(source))
    return late_inside.select(*columns).unionByName(late_edges.select(*columns))


# --- summaries and budgets -----------------------------------------------------------

def source_summary(df: DataFrame, time: str = "recorded_at", kind: str | None = "kind",
                   size: str | None = None, file: str | None = None) -> DataFrame:
    """records, per-kind counts, bytes, files, first and last time, in one pass."""
    us = micros(time)
    zero = F.lit(0).cast("long")
    aggs = [F.count(F.lit(1)).cast("long").alias("records"), F.min(us).alias("first_us"),
            F.max(us).alias("last_us")]
    if kind:
        aggs += [count_if(F.col(kind) == "decision").alias("decisions"),
                 count_if(F.col(kind) == "outcome").alias("outcomes")]
    aggs.append((F.coalesce(F.sum(size), zero) if size else zero).cast("long").alias("bytes"))
    aggs.append((F.count_distinct(F.col(file)) if file else zero).cast("long").alias("files"))
    return df.agg(*aggs)


def scan_budget(summary: DataFrame, max_records: int | None = None, max_files: int | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """One row per declared limit: observed, allowed, ok."""
    limits = [(name, column, limit) for name, column, limit in (
        ("records", "records", max_records), ("files", "files", max_files),
        ("bytes", "bytes", max_bytes)) if limit is not None]
    rows = F.array(*[F.struct(F.lit(n).alias("limit"), F.col(c).alias("observed"),
                              F.lit(m).cast("long").alias("allowed"),
                              (F.col(c) <= m).alias("ok")) for n, c, m in limits])
    return summary.select(F.inline(rows))


def enforce_budget(budget: DataFrame) -> DataFrame:
    """Fail the job when a limit is exceeded."""
    return budget.withColumn("ok", F.coalesce(
        F.when(F.col("ok"), F.lit(True)),
        F.raise_error(F.concat(F.lit("scan budget exceeded: "), F.col("limit"))).cast("boolean")))


# --- requests ------------------------------------------------------------------------

def request_reason() -> Column:
    """Why a scoring request breaks its contract, else NULL."""
    o = "observations."

    def known(name: str) -> Column:
        return optional_class(o + name) != "unknown"

    identity = (in_or_absent(o + "crawler_class", V.CRAWLER_CLASSES)
                & in_or_absent(o + "crawler_verification", V.CRAWLER_VERIFICATIONS)
                & (~F.coalesce(F.col(o + "verified_bot"), F.lit(False))
                   | (known("crawler_class") & known("crawler_verification"))))
    transport = (in_or_absent(o + "transport_protocol", V.TRANSPORT_PROTOCOLS)
                 & in_or_absent(o + "transport_security", V.TRANSPORT_SECURITY)
                 & in_or_absent(o + "client_address_source", V.ADDRESS_SOURCES))
    edge = (in_or_absent(o + "edge_fingerprint_class", V.FINGERPRINT_CLASSES)
            & in_or_absent(o + "edge_fingerprint_method", V.FINGERPRINT_METHODS)
            & in_or_absent(o + "network_reputation", V.NETWORK_REPUTATIONS)
            & in_or_absent(o + "network_type", V.NETWORK_TYPES)
            & (known("edge_fingerprint_class") == known("edge_fingerprint_method")))
    return first_reason(
        (F.octet_length("session_id").between(8, 128)
         & F.col("action").isin(*V.REQUEST_ACTIONS), "session_or_action"),
        (F.col("endpoint_class").isin(*V.ENDPOINT_CLASSES) & (F.col("sequence") >= 1),
         "endpoint_or_sequence"),
        (~F.col("session_id").rlike(r"[\r\n\x00]"), "control_character"),
        (F.col(o + "browser_event_count").between(0, 10_000)
         & F.col(o + "honeypot_hits").between(0, 100), "count_bounds"),
        (F.col(o + "external_risk_score").between(0.0, 1.0)
         & is_finite(F.col(o + "external_risk_score")), "risk_bounds"),
        (in_or_absent("evaluation_cohort", V.COHORTS), "cohort"),
        (identity, "crawler_identity"),
        (transport, "transport"),
        (edge, "edge_intelligence"),
        (in_or_absent(o + "challenge_verdict", V.CHALLENGE_VERDICTS), "challenge_verdict"))


def validate_decision_request(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_valid(df, request_reason())


# --- decision log --------------------------------------------------------------------

DECISION_FIELDS = (
    "decision_id", "request_action", "endpoint_class", "evaluation_cohort", "action",
    "computed_action", "mode", "rollout_id", "scores", "reason_codes", "policy_version",
    "model_version", "assurance_level", "assurance_withheld")


def valid_outcome(o: Column, need_id: Column) -> Column:
    """Outcome contract: id rules, endpoint and the allowed triples."""
    triple = F.concat_ws("|", o.outcome, o.provenance, o.confidence)
    id_ok = F.when(F.coalesce(o.decision_id, F.lit("")) == "", ~need_id).otherwise(
        o.decision_id.rlike(V.STABLE_VALUE))
    return F.coalesce(
        id_ok & o.endpoint_class.isin(*V.ENDPOINT_CLASSES)
        & triple.isin(*["|".join(t) for t in V.OUTCOME_TRIPLES]), F.lit(False))


def log_reason(max_assurance_level: int = 1, versions: tuple[str, str, str, str] = LOG_VERSIONS) -> Column:
    """Why a log record (tagged union, any readable generation) is rejected, else NULL.

    `versions` are the four generations as their producers name them, oldest first.
    """
    d, version = F.col("decision"), F.col("schema_version")
    legacy, newest = version == versions[0], version == versions[3]
    delays = version.isin(*versions[2:])
    reasons = F.coalesce(d.reason_codes, F.array().cast("array<string>"))   # an absent list is empty

    def action_ok(a: Column) -> Column:
        return a.isin(*[x for x in V.ACTIONS if x != "delay"]) | ((a == "delay") & delays)

    cohort = F.coalesce(d.evaluation_cohort, F.lit(""))
    cohort_ok = F.when(legacy, cohort == "").otherwise(cohort.isin(*V.COHORTS))
    scores_ok = (d.scores.automation_risk.between(0, 1) & d.scores.abuse_intent_risk.between(0, 1)
                 & d.scores.account_continuity.between(0, 1))
    rollout = F.coalesce(d.rollout_id, F.lit(""))
    level = d.assurance_level
    is_decision = F.col("kind") == "decision"

    def if_decision(ok: Column) -> Column:
        return ~is_decision | ok

    return first_reason(
        (version.isin(*versions) & F.col("kind").isin("decision", "outcome"), "version_or_kind"),
        (F.col("recorded_at") == F.date_trunc("second", "recorded_at"), "recorded_at"),
        (F.col("session_key").rlike(V.SESSION_KEY), "session_key"),
        (F.when(is_decision, d.isNotNull() & F.col("outcome").isNull())
         .otherwise(F.col("outcome").isNotNull() & d.isNull()), "shape"),
        (if_decision(
            d.decision_id.rlike(V.STABLE_VALUE) & d.request_action.isin(*V.LOGGED_ACTIONS)
            & d.endpoint_class.isin(*V.ENDPOINT_CLASSES) & cohort_ok
            & action_ok(d.action) & action_ok(d.computed_action) & d.mode.isin(*V.MODES)
            & scores_ok & ((rollout == "") | rollout.rlike(V.STABLE_VALUE))
            & d.policy_version.rlike(V.STABLE_VALUE) & d.model_version.rlike(V.STABLE_VALUE)
            & (F.size(reasons) <= 32)), "decision"),
        (if_decision(level.isNull() | (newest & level.between(0, max_assurance_level))),
         "assurance_level"),
        (if_decision(~F.coalesce(d.assurance_withheld, F.lit(False)) | level.isNotNull()),
         "assurance_withheld"),
        (if_decision((d.mode != "canary") | (rollout != "")), "canary_rollout"),
        (if_decision(F.forall(reasons, lambda r: r.rlike(V.STABLE_VALUE))), "reason_code"),
        (is_decision | valid_outcome(F.col("outcome"), ~legacy), "outcome"))


def decode_log_records(df: DataFrame, versions: tuple[str, str, str, str] = LOG_VERSIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, outcomes, quarantine) of tagged log records."""
    return _kinds(*split_valid(df, log_reason(versions=versions)))


def split_log_records(df: DataFrame, path: str, versions: tuple[str, str, str, str] = LOG_VERSIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`decode_log_records` by one scan: a table with a partition for each kind and one for the quarantine.

    Readers of a result read its partition only. `path` must not exist. The write needs no sort: a task has three partitions.
    """
    marked = df.withColumn("reason", log_reason(versions=versions))
    part = F.when(F.col("reason").isNotNull(), F.lit("quarantine")).otherwise(F.col("kind"))
    with open_files(df.sparkSession, 3):
        marked.withColumn("part", part).write.partitionBy("part").mode("errorifexists").parquet(path)
    table = df.sparkSession.read.schema(marked.withColumn("part", part).schema).parquet(path)
    return _kinds(table.filter("part IN ('decision', 'outcome')").drop("part", "reason"),
                  table.filter("part = 'quarantine'").drop("part"))


def _kinds(valid: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    keep = [c for c in ("ingest_order",) if c in valid.columns]
    decisions = valid.filter("kind = 'decision'").select(
        *keep, "schema_version", "recorded_at", "session_key",
        *[F.col(f"decision.{f}").alias(f) for f in DECISION_FIELDS]
    ).withColumns({"evaluation_cohort": optional_class("evaluation_cohort"),
                   "reason_codes": F.coalesce("reason_codes", F.array().cast("array<string>"))})
    outcomes = valid.filter("kind = 'outcome'").select(
        *keep, "schema_version", "recorded_at", "session_key",
        *[F.col(f"outcome.{f}").alias(f) for f in
          ("decision_id", "endpoint_class", "outcome", "provenance", "confidence")])
    return decisions, outcomes, bad


def allowed_triples(df: DataFrame) -> DataFrame:
    """The fixed outcome vocabulary as a dimension table."""
    return df.sparkSession.createDataFrame(
        list(V.OUTCOME_TRIPLES), "outcome string, provenance string, confidence string")


def validate_outcomes(df: DataFrame, need_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): semi and anti join with the allowed triples.

    The dimension is a constant of a dozen rows, so broadcasting it is safe.
    """
    id_ok = F.col("decision_id").rlike(V.STABLE_VALUE)
    if not need_id:
        id_ok = (F.coalesce("decision_id", F.lit("")) == "") | id_ok
    ok = F.coalesce(id_ok & F.col("endpoint_class").isin(*V.ENDPOINT_CLASSES), F.lit(False))
    triples = F.broadcast(allowed_triples(df))
    on = ["outcome", "provenance", "confidence"]
    valid = df.filter(ok).join(triples, on, "left_semi").select(*df.columns)
    bad = (df.filter(ok).join(triples, on, "left_anti").select(*df.columns)
           .withColumn("reason", F.lit("triple"))
           .unionByName(df.filter(~ok).withColumn("reason", F.lit("id_or_endpoint"))))
    return valid, bad


def stable_or_unknown(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c.rlike(V.STABLE_VALUE), F.lit(False)), c).otherwise(F.lit("unknown"))


def normalise_log_row(df: DataFrame) -> DataFrame:
    """The log form of a decision row; foreign values fall back, never leak."""
    other = F.lit("other")
    action, endpoint = F.col("request_action"), F.col("endpoint_class")
    stable = F.filter("reason_codes", lambda r: r.rlike(V.STABLE_VALUE))
    rollout = F.col("rollout_id")
    return df.withColumns({
        "request_action": F.when(action.isin(*V.LOGGED_ACTIONS), action).otherwise(other),
        "endpoint_class": F.when(endpoint.isin(*V.ENDPOINT_CLASSES), endpoint).otherwise(other),
        "evaluation_cohort": optional_class("evaluation_cohort"),
        "decision_id": stable_or_unknown("decision_id"),
        "rollout_id": F.when(F.coalesce(rollout, F.lit("")) == "", F.lit(None).cast("string"))
        .otherwise(stable_or_unknown(rollout)),
        "policy_version": stable_or_unknown("policy_version"),
        "model_version": stable_or_unknown("model_version"),
        "reason_codes": F.slice(stable, 1, 32),
        "recorded_at": F.date_trunc("second", "recorded_at"),
    })


# --- retention and feeds ---------------------------------------------------------------

DAY_US = 86_400 * V.MICROS


def oldest_kept(now: Column, keep_days: int) -> Column:
    """The oldest time that a retention of 1 to 90 days keeps."""
    if not 1 <= keep_days <= 90:
        raise ValueError("retention must be 1 to 90 days")
    return now - F.expr(f"INTERVAL {keep_days} DAYS")


def apply_retention(df: DataFrame, now: Column, keep_days: int = 7, time: str = "recorded_at") -> DataFrame:
    """Rows not older than the retention; `sources.retention` has the table that prunes by it."""
    return df.filter(F.col(time) >= oldest_kept(now, keep_days))


def latest_valid_report(attempts: DataFrame, key: str | None = None) -> DataFrame:
    """Newest valid snapshot and whether the newest attempt was valid.

    `attempts` carries attempted_at, valid and report.
    """
    groups = [key] if key else []
    at = micros("attempted_at")
    good = F.when(F.col("valid"), F.struct(at.alias("us"), F.col("report").alias("report")))
    out = attempts.groupBy(*groups).agg(
        F.max(good).alias("_good"), F.max(F.struct(at.alias("us"), F.col("valid"))).alias("_new"))
    state = (F.when(F.col("_good").isNull(), F.lit("unavailable"))
             .when(F.col("_new.valid"), F.lit("ready")).otherwise(F.lit("invalid_update")))
    return out.select(*groups, F.col("_good.report").alias("report"),
                      F.col("_good.us").alias("report_us"), F.col("_new.us").alias("attempted_us"),
                      state.alias("state"))
