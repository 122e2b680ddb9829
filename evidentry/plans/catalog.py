"""Registered queries: operators applied to evidence derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import count_if, items, micros, proportion_difference, rates, wilson
from ..functions.timeline import shared_folder, stored
from ..operators import analysis as G
from ..operators import challenge as H
from ..operators import contracts as A
from ..operators import decide as D
from ..operators import detect as X
from ..operators import holdout as O
from ..operators import identity as I
from ..operators import linkage as L
from ..operators import pseudonym as B
from ..operators import rollout as R
from ..operators import score as P
from ..operators import session as S
from ..operators import telemetry as M
from ..operators import windows as W
from ..sources import importer, jsonl, reports, sealed, shards
from ..streaming import operators as J
from .. import vocab as V
from . import derived as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def n() -> F.Column:
    return F.count(F.lit(1)).cast("long")


# --- C: decision scoring -----------------------------------------------------------

def _scored(spark, sf):
    return D.score_requests(T.requests(spark, sf))


def _decided(spark, sf):
    return D.decide(T.requests(spark, sf))


@query
def c_decisions_by_endpoint(spark, sf):
    """Flagship: requests -> session features -> detectors -> scores -> policy -> counts."""
    return (_decided(spark, sf).groupBy("endpoint_class", "computed_action")
            .agg(n().alias("decisions"), F.max("request_count").cast("long").alias("max_requests")))


@query
def c1_session_epochs(spark, sf):
    us = micros("observed_at")
    return (S.session_epochs(T.requests(spark, sf)).groupBy("session_id", "epoch")
            .agg(n().alias("requests"), F.min(us).alias("first_us"), F.max(us).alias("last_us")))


@query
def c2_session_features(spark, sf):
    return S.session_features(T.requests(spark, sf)).select(
        "line_no", "epoch", "request_count", "first_seen_us", "max_sequence_gap",
        F.col("distinct_endpoint_classes").cast("long").alias("distinct_endpoint_classes"),
        "endpoint_transitions")


@query
def c8_detector_signals(spark, sf):
    return (items(_scored(spark, sf), F.col("evidence.code"), "code").groupBy("code")
            .agg(n().alias("n")).filter(F.col("code").isNotNull()))


def _signal_counts(df):
    return (items(df, F.col("evidence.code"), "code").groupBy("code")
            .agg(n().alias("n")).filter(F.col("code").isNotNull()))


@query
def c8_burst_signals(spark, sf):
    """Signals of sessions that are large and fast: volume, burst and surface sweep."""
    return _signal_counts(D.score_requests(T.busy_requests(spark, sf)))


@query
def c8_decoy_signals(spark, sf):
    """Signals after verified decoy hits were attached to the requests."""
    requests = T.requests(spark, sf)
    hits = S.attach_decoy_hits(requests, S.redeem_decoys(T.decoy_issued(spark, sf), T.decoy_hits(spark, sf)))
    joined = requests.join(hits, ["session_id", "line_no"])
    joined = joined.withColumn("observations", F.col("observations").withField(
        "verified_decoy_hits", F.col("verified_decoy_hits"))).drop("verified_decoy_hits")
    return _signal_counts(D.score_requests(joined))


@query
def c8_user_detector(spark, sf):
    """A registry with a detector of the user's own beside two built-in ones."""
    mine = X.Detector("night_watch_v1", (
        X.Signal("OTHER_SURFACE_REPEATED", "intent", 1, .4, .5,
                 (F.col("endpoint_class") == "other") & (F.col("request_count") > 1)),))
    config = D.DecisionConfig(detectors=(*X.default_detectors(), mine),
                              enabled_detectors=("campaign_surface_v1", "night_watch_v1"))
    return _signal_counts(D.score_requests(T.requests(spark, sf), config))


@query
def c9_detect(spark, sf):
    codes = F.concat_ws(",", "evidence.code")
    return _scored(spark, sf).select("line_no", F.nullif(codes, F.lit("")).alias("codes"))


@query
def c11_fuse_scores(spark, sf):
    df = P.fuse_scores(_scored(spark, sf).drop("scores"))
    return df.select("line_no", *[F.col(f"scores.{s}").alias(s) for s in P.SCORES])


@query
def c12_apply_policy(spark, sf):
    return _scored(spark, sf).select("line_no", "computed_action", "policy_reason")


@query
def c14_verified_crawler(spark, sf):
    return (T.requests(spark, sf)
            .groupBy(X.obs("crawler_class").alias("crawler_class"),
                     X.verified_public_crawler().alias("qualified")).agg(n().alias("n")))


@query
def c15_shadow_mode(spark, sf):
    return (D.apply_shadow_mode(_scored(spark, sf)).groupBy("computed_action", "action")
            .agg(n().alias("n")))


@query
def c16_assemble_decisions(spark, sf):
    return _decided(spark, sf).select(
        "line_no", "action", F.concat_ws(",", "reason_codes").alias("reason_codes"),
        micros("expires_at").alias("expires_us"), F.col("directive.handling").alias("handling"),
        micros("directive.expires_at").alias("directive_expires_us"))


@query
def c17_replay(spark, sf):
    return D.replay(T.requests(spark, sf)).select("line_no", "matched")


@query
def c17_first_mismatch(spark, sf):
    return D.first_mismatch(D.replay(T.requests(spark, sf))).select(
        micros("observed_at").alias("observed_us"), "line_no", "expected_action", "action",
        "expected_computed_action", "computed_action")


# --- A: contracts --------------------------------------------------------------------

def _reasons(valid: DataFrame, bad: DataFrame, *keys: str) -> DataFrame:
    both = (valid.select(F.lit("valid").alias("reason"), *keys)
            .unionByName(bad.select("reason", *keys)))
    return both.groupBy("reason", *keys).agg(n().alias("n"))


def _marked(df: DataFrame, reason: F.Column, *keys: str) -> DataFrame:
    """Counts per reason in one pass, without splitting the rows."""
    return (df.select(*keys, F.coalesce(reason, F.lit("valid")).alias("reason"))
            .groupBy("reason", *keys).agg(n().alias("n")))


@query
def a2_validate_evidence(spark, sf):
    return _marked(T.rough_local_events(spark, sf), A.evidence_reason())


@query
def a2_evidence_quarantine(spark, sf):
    return A.validate_evidence(T.rough_local_events(spark, sf))[1].select("line_no", "reason")


@query
def a3_check_chronology(spark, sf):
    return A.check_chronology(T.local_events_raw(spark, sf), "observed_at", "line_no")


def _log_times(spark, sf):
    d = T.logged(spark, sf)
    return (d.select("recorded_at", F.lit("decision").alias("kind"))
            .unionByName(T.outcomes(d).select("recorded_at", F.lit("outcome").alias("kind"))))


@query
def a6_source_summary(spark, sf):
    return A.source_summary(_log_times(spark, sf))


@query
def a7_scan_budget(spark, sf):
    """Reported, not enforced: `enforce_budget` would stop the job above the limit."""
    return A.scan_budget(A.source_summary(_log_times(spark, sf)), max_records=1_000_000)


@query
def a8_validate_decision_request(spark, sf):
    return _marked(T.rough_requests(spark, sf), A.request_reason())


@query
def a9_decode_log_records(spark, sf):
    return _marked(T.log_records(_decided(spark, sf)), A.log_reason(), "kind")


@query
def a9_split_log_records(spark, sf):
    """Decisions, outcomes and quarantine of the log, written by one scan and read back."""
    decisions, outcomes, bad = A.split_log_records(T.log_records(_decided(spark, sf)), shared_folder(spark, "log-kinds"))
    none = F.lit(None).cast("string")
    rows = [decisions.select(F.lit("decision").alias("part"), none.alias("reason"), "endpoint_class", "recorded_at"),
            outcomes.select(F.lit("outcome").alias("part"), none.alias("reason"), "endpoint_class", "recorded_at"),
            bad.select(F.concat(F.lit("quarantine-"), F.col("kind")).alias("part"), "reason", none.alias("endpoint_class"), "recorded_at")]
    us = micros("recorded_at")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("part", "reason", "endpoint_class").agg(
        n().alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query
def a10_validate_outcomes(spark, sf):
    out = T.outcomes(T.logged(spark, sf)).withColumn(
        "provenance", F.when(F.minute("recorded_at") % 7 == 0, F.lit("user_feedback"))
        .otherwise(F.col("provenance")))
    return _reasons(*A.validate_outcomes(out), "outcome")


@query
def a11_normalise_log_row(spark, sf):
    e = F.col("line_no")
    rough = T.logged(spark, sf).withColumns({
        "endpoint_class": F.when(e % 31 == 0, F.lit("basement")).otherwise(F.col("endpoint_class")),
        "decision_id": F.when(e % 37 == 0, F.lit("not stable!")).otherwise(F.col("decision_id")),
        "reason_codes": F.when(e % 41 == 0, F.array_append("reason_codes", F.lit("not stable!")))
        .otherwise(F.col("reason_codes"))})
    return A.normalise_log_row(rough).select(
        "line_no", F.col("copy"), "endpoint_class", "decision_id",
        F.concat_ws(",", "reason_codes").alias("reason_codes"), micros("recorded_at").alias("recorded_us"))


@query
def a12_session_key(spark, sf):
    return T.requests(spark, sf).select("session_id").distinct().withColumn(
        "session_key", B.session_key("session_id", T.LOG_KEY))


@query
def a14_apply_retention(spark, sf):
    d = T.logged(spark, sf)
    latest = d.agg(F.max("recorded_at").alias("_now"))
    kept = A.apply_retention(d.crossJoin(F.broadcast(latest)), F.col("_now"), keep_days=1)
    return kept.select("decision_id", "copy", micros("recorded_at").alias("recorded_us"))


@query
def a14_retention_table(spark, sf):
    """The decision log as a table by day, written twice, old days dropped, and the rest read within the retention."""
    from ..sources import retention

    folder = shared_folder(spark, "by-day")
    log = T.logged(spark, sf).select("decision_id", "copy", "recorded_at")
    for _ in range(2):
        retention.write_dated(log, folder)
    newest = spark.read.schema(log.schema).parquet(folder).agg(F.max("recorded_at").alias("t")).first()["t"]
    if newest is None:
        return log.select("decision_id", "copy", micros("recorded_at").alias("recorded_us"))
    retention.drop_expired(spark, folder, newest, keep_days=2)
    kept = retention.read_retained(spark, folder, newest, keep_days=1)
    return kept.select("decision_id", "copy", micros("recorded_at").alias("recorded_us"))


@query
def a16_latest_valid_report(spark, sf):
    attempts = T.requests(spark, sf).select(
        "session_id", F.col("observed_at").alias("attempted_at"),
        (F.col("line_no") % 4 != 0).alias("valid"), F.col("line_no").alias("report"))
    return A.latest_valid_report(attempts, "session_id")


# --- B: pseudonyms -------------------------------------------------------------------

@query
def b2_pseudonymise(spark, sf):
    out = B.pseudonymise(T.local_events_raw(spark, sf), b"k" * 32, "dataset-a", "pilot-a")
    return B.assert_no_direct_refs(out).select("line_no", "subject_id", "session_id")


# --- C: history, batches, decoys -------------------------------------------------------

def _enforced(spark, sf):
    return D.decide(T.requests(spark, sf), D.DecisionConfig(plan=T.rollout_plan(), cohort_key=T.LOG_KEY))


@query
def c3_enforcement_history(spark, sf):
    return _enforced(spark, sf).select(
        "line_no", F.col("recent_enforcements").cast("long").alias("recent_enforcements"),
        F.col("premature_retries").cast("long").alias("premature_retries"))


@query
def c4_ingest_event_batches(spark, sf):
    return S.ingest_event_batches(T.event_batches(spark, sf)).select(
        "line_no", F.col("accepted_events").cast("long").alias("accepted_events"),
        F.col("total_accepted_events").cast("long").alias("total_accepted_events"), "batch_sequence")


@query
def c5_verified_event_count(spark, sf):
    receipts = S.ingest_event_batches(T.event_batches(spark, sf))
    return S.verified_event_count(T.requests(spark, sf), receipts)


@query
def c6_redeem_decoys(spark, sf):
    return S.redeem_decoys(T.decoy_issued(spark, sf), T.decoy_hits(spark, sf)).select(
        "capability", micros("hit_at").alias("hit_us"), "hit_line_no", "interaction")


@query
def c6_issue_decoys(spark, sf):
    """Capabilities that may be issued, and why the others must not."""
    issued, refused = S.issue_decoys(T.wanted_decoys(spark, sf))
    return issued.select("capability", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("capability", "reason"))


@query
def c7_attach_decoy_hits(spark, sf):
    redeemed = S.redeem_decoys(T.decoy_issued(spark, sf), T.decoy_hits(spark, sf))
    return S.attach_decoy_hits(T.requests(spark, sf), redeemed).withColumn(
        "verified_decoy_hits", F.col("verified_decoy_hits").cast("long"))


@query
def c9_detect_subset(spark, sf):
    config = D.DecisionConfig(enabled_detectors=("decoy_interaction_v2", "protocol_consistency_v2"))
    return (D.score_requests(T.requests(spark, sf), config)
            .groupBy("computed_action", "policy_reason").agg(n().alias("n")))


@query
def c10_validate_evidence_rows(spark, sf):
    e = F.col("line_no")
    bad = F.transform("evidence", lambda x: x.withField(
        "strength", F.when(e % 31 == 0, 1.25).otherwise(x.strength)).withField(
        "code", F.when(e % 37 == 0, F.lit("lower")).otherwise(x.code)))
    df = _scored(spark, sf).select(e, bad.alias("evidence"))
    return X.validate_evidence_rows(df).select("line_no", "evidence_valid")


@query
def c18_event_shadow_decisions(spark, sf):
    receipts = S.ingest_event_batches(T.event_batches(spark, sf))
    return D.event_shadow_decisions(receipts, "read", "public_content").select(
        "line_no", "action", "computed_action", F.concat_ws(",", "reason_codes").alias("reason_codes"))


@query
def c19_derive_assurance(spark, sf):
    df = _scored(spark, sf).withColumn("liveness_verified", F.col("line_no") % 3 == 0)
    return I.derive_assurance(df).select(
        "line_no", F.col("assurance_level").cast("long").alias("assurance_level"),
        F.concat_ws(",", "assurance_sources").alias("sources"),
        F.concat_ws(",", "assurance_reasons").alias("reasons"), "assurance_withheld")


@query
def c20_agent_provenance(spark, sf):
    return (I.agent_provenance(T.requests(spark, sf))
            .groupBy("provenance", "purpose", F.concat_ws(",", "provenance_reasons").alias("reasons"))
            .agg(n().alias("n")))


@query
def c21_verify_crawlers(spark, sf):
    return I.verify_crawlers(T.user_agents(spark, sf), T.crawler_registry()).select(
        "line_no", "verified_bot", "crawler_class", "crawler_verification")


@query
def c22_normalise_transport(spark, sf):
    return I.normalise_transport(T.user_agents(spark, sf), T.TRUSTED_PROXIES).select(
        "line_no", "transport_protocol", "transport_security", "client_address_source")


@query
def c23_merge_signals(spark, sf):
    df = I.merge_signals(T.edge_signals(spark, sf))
    return df.select("line_no", "signal_conflict", *[
        F.col(f"observations.{c}").alias(c) for c in I.MERGED],
        F.col("observations.external_risk_score").alias("external_risk_score"),
        F.col("observations.policy_alert").alias("policy_alert"))


@query
def c23_edge_envelopes(spark, sf):
    return I.audit_edge_envelopes(T.edge_envelopes(spark, sf), T.LOG_KEY).select("line_no", "use")


@query
def c24_audit_single_use(spark, sf):
    df = T.proofs(spark, sf)
    signed = F.col("signature") == I.signature("payload", T.LOG_KEY)
    return I.audit_single_use(df, F.col("well_formed"), signed).select("line_no", "use")


@query
def c25_monotone_revisions(spark, sf):
    return I.monotone_revisions(T.revisions(spark, sf), "document").select(
        "document", "line_no", "update", "installed_revision")


@query
def c26_issuer_trust(spark, sf):
    return I.issuer_trust(*T.trust_tables(spark, sf)).select(
        "line_no", "trusted", F.col("maximum_assurance_level").cast("long").alias("maximum_assurance_level"),
        "uniqueness_scope")


@query
def c27_challenge_lifecycle(spark, sf):
    return H.challenge_lifecycle(*T.challenges(spark, sf)).select("challenge_id", "outcome")


@query
def c28_liveness_attempts(spark, sf):
    return H.liveness_attempts(*T.liveness(spark, sf)).select("attempt_id", "state", "failure")


# --- D: rollout ------------------------------------------------------------------------

@query
def d1_canary_bucket(spark, sf):
    return T.requests(spark, sf).select("session_id").distinct().withColumn(
        "bucket", R.canary_bucket(F.col("session_id"), "canary-a", T.LOG_KEY).cast("long"))


@query
def d2_apply_rollout(spark, sf):
    df = R.apply_rollout(_scored(spark, sf).drop("action"), T.canary_plan(), T.LOG_KEY)
    return df.select("line_no", "action", "mode", F.concat_ws(",", "rollout_reasons").alias("reasons"))


@query
def d3_response_cost(spark, sf):
    return _enforced(spark, sf).select(
        "line_no", F.col("response_cost_tier").cast("long").alias("tier"),
        F.col("directive.retry_after_seconds").cast("long").alias("retry_after_seconds"))


@query
def d4_directive(spark, sf):
    df = R.directive(_scored(spark, sf), T.rollout_plan(), "computed_action")
    return df.select(
        "line_no", F.col("directive.handling").alias("handling"),
        F.col("directive.http_status").cast("long").alias("http_status"),
        F.col("directive.retry_after_seconds").cast("long").alias("retry_after_seconds"),
        micros("directive.expires_at").alias("expires_us"))


@query
def d2_enforced_decisions(spark, sf):
    return _enforced(spark, sf).select("line_no", "action", "mode",
                                       F.concat_ws(",", "reason_codes").alias("reason_codes"))


# --- E: activity windows ----------------------------------------------------------------

def _windows(spark, sf):
    return W.windows_of(T.local_events(spark, sf))


@query
def e1_sequence_key(spark, sf):
    return (W.sequence_key(T.local_events(spark, sf)).groupBy("sequence_key")
            .agg(n().alias("events")))


@query
def e2_sequence_windows(spark, sf):
    df = W.sequence_windows(W.sequence_key(T.local_events(spark, sf)))
    return df.select("line_no", "sequence_key", "window_us")


@query
def e3_closure_reason(spark, sf):
    return _windows(spark, sf).select("sequence_key", "first_us", "closure", "closed_us")


@query
def e4_peak_minute(spark, sf):
    return _windows(spark, sf).select("sequence_key", "first_us", "peak_minute", "peak_bucket")


@query
def e5_burst_shape(spark, sf):
    return _windows(spark, sf).groupBy("burst_shape").agg(n().alias("n"))


@query
def e6_endpoint_transitions(spark, sf):
    return _windows(spark, sf).select(
        "sequence_key", "first_us", "transitions", "same_class", "sensitive_escalations",
        "decoy_entries")


@query
def e7_window_features(spark, sf):
    return _windows(spark, sf).select(
        "sequence_key", "first_us", "last_us", "events", "collection_issue",
        *[F.col(c).cast("long").alias(c) for c in
          ("automation", "abuse_intent", "continuity", "decoy", "challenge_flags")],
        *W.ENDPOINT_EVENTS)


@query
def e8_challenge_state(spark, sf):
    return _windows(spark, sf).groupBy("challenge_state").agg(n().alias("n"))


@query
def e9_window_label(spark, sf):
    return _windows(spark, sf).groupBy("label").agg(n().alias("n"))


@query
def e10_sequence_report(spark, sf):
    return W.sequence_report(_windows(spark, sf))


@query
def e11_peak_active(spark, sf):
    return W.peak_active(_windows(spark, sf))


@query
def e12_check_sequence_report(spark, sf):
    return W.check_sequence_report(W.sequence_report(_windows(spark, sf)))


# --- F: sequence holdout ------------------------------------------------------------------

def _cutoff(events: DataFrame) -> DataFrame:
    """The middle of the observed time range."""
    us = F.unix_micros("observed_at")
    return events.agg(T.div(F.min(us) + F.max(us), 2).alias("cutoff_us"))


def _no_contract() -> F.Column:
    return F.lit(None).cast("string")


def _families(spark, sf):
    # The derived ids are readable stand-ins for pseudonyms, so their form is not checked.
    return O.load_families(T.families(spark, sf).withColumn(
        "schema_version", F.lit(O.FAMILY_VERSION)), _no_contract())[0]


def _split(spark, sf):
    w = _windows(spark, sf).crossJoin(F.broadcast(_cutoff(T.local_events(spark, sf))))
    w = stored(O.attach_families(O.split_windows(w, F.col("cutoff_us")), _families(spark, sf)), "split-windows")
    return O.mark_unseen(w)


@query
def f1_load_families(spark, sf):
    rough = T.rough_families(spark, sf)
    families, bad = O.load_families(rough)
    return (families.select(F.lit("valid").alias("reason"), F.lit(1).alias("records"))
            .unionByName(bad.select("reason", "records"))
            .groupBy("reason").agg(n().alias("sequences"), F.sum("records").cast("long").alias("records")))


@query
def f2_split_windows(spark, sf):
    w = _windows(spark, sf).crossJoin(F.broadcast(_cutoff(T.local_events(spark, sf))))
    return O.split_windows(w, F.col("cutoff_us")).groupBy("part", "label").agg(
        n().alias("windows"), F.sum("events").alias("events"))


@query
def f3_attach_families(spark, sf):
    annotated = F.col("family").isNotNull()
    return _split(spark, sf).groupBy(annotated.alias("annotated"), "label").agg(n().alias("windows"))


@query
def f4_unseen_families(spark, sf):
    return O.unseen_families(_split(spark, sf))


@query
def f5_rule_matches(spark, sf):
    return O.rule_matches(_windows(spark, sf)).groupBy("rule", "flagged").agg(n().alias("windows"))


@query
def f6_rule_confusion(spark, sf):
    df = O.rule_confusion(_split(spark, sf))
    return df.select(*[rounded(c) if c.endswith(("_rate", "95")) else F.col(c) for c in df.columns])


def rounded(c: str) -> F.Column:
    return (F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c)


@query
def f6_holdout_report(spark, sf):
    return O.holdout_report(_split(spark, sf))


@query
def f7_holdout_readiness(spark, sf):
    report = O.holdout_report(_split(spark, sf))
    return O.holdout_readiness(report, 5, 2).select("state", F.concat_ws(",", "reasons").alias("reasons"))


@query
def f8_check_holdout_report(spark, sf):
    w = stored(_split(spark, sf), "marked-windows")
    return O.check_holdout_report(O.holdout_report(w), O.rule_confusion(w))


# --- G: decision and outcome analysis --------------------------------------------------------

def _log(spark, sf):
    """Decisions as a written table, as a log would be: outcomes derive from it twice."""
    d = stored(T.logged(spark, sf), "log")
    return d, T.outcomes(d)


def _stored_links(d, o):
    """The links as a table: all consumers of one query read the same join."""
    return stored(L.link_outcomes(d, o), "links")


def _links(spark, sf):
    """Links with the latest time of the log on every row."""
    d, o = _log(spark, sf)
    return L.link_outcomes(d, o).crossJoin(F.broadcast(G.last_time(d, o)))


def _round(df: DataFrame) -> DataFrame:
    ends = ("_rate", "95", "_estimate", "_friction", "coverage", "mean", "throughput")
    return df.select(*[rounded(c) if c.endswith(ends) and dict(df.dtypes)[c] == "double" else F.col(c)
                       for c in df.columns])


@query
def g1_decision_summary(spark, sf):
    return _round(G.decision_summary(T.logged(spark, sf)))


@query
def g2_outcome_summary(spark, sf):
    d, o = _log(spark, sf)
    return _round(G.outcome_summary(o, d))


@query
def g3_score_summary(spark, sf):
    return _round(G.score_summary(T.logged(spark, sf)))


@query
def g4_endpoint_summary(spark, sf):
    return _round(G.endpoint_summary(*_log(spark, sf)))


@query
def g5_top_counts(spark, sf):
    return G.top_counts(T.logged(spark, sf), "reason_codes", 10)


@query
def g6_distinct_budget(spark, sf):
    return G.distinct_budget(T.logged(spark, sf), ("reason_codes", "policy_version", "rollout_id"))


@query
def g7_link_outcomes(spark, sf):
    return L.link_outcomes(*_log(spark, sf)).select(
        "decision_id", "decision_seen", "decision_records", "outcome_events",
        F.col("outcome_mask").cast("long").alias("outcome_mask"), "matched", "duplicate_outcomes",
        "eligible", "endpoint_class", "evaluation_cohort", "predicted_risky", "challenged", "rollout_id",
        "assurance_level", "assurance_withheld")


@query
def g8_linkage_summary(spark, sf):
    d, o = _log(spark, sf)
    return _round(L.linkage_summary(L.link_outcomes(d, o), o))


@query
def g9_linked_evaluation(spark, sf):
    return _round(L.linked_evaluation(_links(spark, sf), ["mode"], F.col("last_us")))


@query
def g10_evaluation_slices(spark, sf):
    return _round(L.evaluation_slices(_links(spark, sf), F.col("last_us")))


@query
def g11_assurance_slices(spark, sf):
    return _round(L.assurance_slices(_links(spark, sf), F.col("last_us")))


@query
def g12_canary_comparison(spark, sf):
    return _round(G.canary_comparison(T.logged(spark, sf)))


@query
def g13_canary_challenge_budget(spark, sf):
    d, o = _log(spark, sf)
    links = L.link_outcomes(d, o).crossJoin(F.broadcast(G.last_time(d, o)))
    return _round(L.canary_challenge_budget(d, links, F.col("last_us")))


@query
def g14_wilson(spark, sf):
    """Rate and interval of risky actions per session."""
    d = T.logged(spark, sf).groupBy("session_key").agg(
        F.count(F.lit(1)).cast("long").alias("total"), count_if(G.risky("computed_action")).alias("risky"))
    return _round(d.select("session_key", "total", "risky", *rates({"risky": ("risky", "total")})))


@query
def g15_proportion_difference(spark, sf):
    """Risk difference of each endpoint against all endpoints."""
    d = T.logged(spark, sf).groupBy("endpoint_class").agg(
        F.count(F.lit(1)).cast("long").alias("total"), count_if(G.risky("computed_action")).alias("risky"))
    every = d.agg(F.sum("total").alias("_t"), F.sum("risky").alias("_r"))
    diff = proportion_difference(wilson("risky", "total"), wilson("_r", "_t"))
    return _round(d.crossJoin(F.broadcast(every)).withColumn("_d", diff).select(
        "endpoint_class", F.col("_d.estimate").alias("difference_estimate"),
        F.col("_d.lower95").alias("lower95"), F.col("_d.upper95").alias("upper95")))


def _metrics(d, o, links=None):
    links = _stored_links(d, o) if links is None else links
    overall = L.linked_evaluation(links.crossJoin(F.broadcast(G.last_time(d, o))), [], F.col("last_us"))
    return G.report_metrics(G.decision_summary(d), L.linkage_summary(links, o), overall)


@query
def g16_readiness(spark, sf):
    return G.readiness(_metrics(*_log(spark, sf))).select(
        "state", "operator_action", F.concat_ws(",", "reasons").alias("reasons"), "automatic_enforcement")


@query
def g16_recommendations(spark, sf):
    df = G.recommendations(_metrics(*_log(spark, sf)))
    return df.select(F.col("position").cast("long").alias("position"), "code", "priority", "disposition",
                     "metric", rounded("observed"), "threshold", "unit")


def _half(spark, sf):
    d, o = _log(spark, sf)
    links = L.link_outcomes(d, o).crossJoin(F.broadcast(G.last_time(d, o)))
    middle = d.agg(T.div(F.min(micros("recorded_at")) + F.max(micros("recorded_at")), 2)
                                     .alias("cutoff_us"))
    return L.decision_holdout(links.crossJoin(F.broadcast(middle)), F.col("cutoff_us"), F.col("last_us"))


@query
def g17_decision_holdout(spark, sf):
    return _round(_half(spark, sf))


@query
def g18_decision_holdout_readiness(spark, sf):
    return G.decision_holdout_readiness(_half(spark, sf), 10, 10).select(
        "state", F.concat_ws(",", "reasons").alias("reasons"))


@query
def g19_check_analysis_report(spark, sf):
    d, o = _log(spark, sf)
    links = _stored_links(d, o)
    last = F.broadcast(G.last_time(d, o))
    source = A.source_summary(d.select("recorded_at", F.lit("decision").alias("kind")).unionByName(
        o.select("recorded_at", F.lit("outcome").alias("kind"))))
    timed = links.crossJoin(last)
    return G.check_analysis_report(
        G.decision_summary(d), G.outcome_summary(o, d), G.endpoint_summary(d, o),
        L.linkage_summary(links, o), L.evaluation_slices(timed, F.col("last_us")),
        G.canary_comparison(d), L.canary_challenge_budget(d, timed, F.col("last_us")), source)


@query
def g19_check_readiness(spark, sf):
    """State and recommendations of the report, recomputed from its other tables."""
    d, o = _log(spark, sf)
    links = _stored_links(d, o)
    slices = L.evaluation_slices(links.crossJoin(F.broadcast(G.last_time(d, o))), F.col("last_us"))
    metrics = _metrics(d, o, links)
    return G.check_readiness(G.decision_summary(d), L.linkage_summary(links, o), slices, G.readiness(metrics), G.recommendations(metrics))


@query
def g19_check_decision_holdout(spark, sf):
    d, o = _log(spark, sf)
    links = _stored_links(d, o)
    middle = d.agg(T.div(F.min(micros("recorded_at")) + F.max(micros("recorded_at")), 2).alias("cutoff_us"))
    timed = links.crossJoin(F.broadcast(G.last_time(d, o))).crossJoin(F.broadcast(middle))
    holdout = L.decision_holdout(timed, F.col("cutoff_us"), F.col("last_us"))
    return G.check_decision_holdout(holdout, L.linkage_summary(links, o), G.decision_holdout_readiness(holdout, 10, 10), 10, 10)


# --- D6..D8: rollout review -------------------------------------------------------------------

@query
def d6_dominant_version(spark, sf):
    d = T.logged(spark, sf)
    return (G.dominant_version(d, "policy_version").withColumn("kind", F.lit("policy"))
            .unionByName(G.dominant_version(d, "model_version").withColumn("kind", F.lit("model"))))


def _review_parts(spark, sf):
    d, o = _log(spark, sf)
    links = _stored_links(d, o)
    timed = links.crossJoin(F.broadcast(G.last_time(d, o)))
    return d, o, links, timed, L.evaluation_slices(timed, F.col("last_us"))


@query
def d7_recommend_endpoint(spark, sf):
    d, o, _, _, slices = _review_parts(spark, sf)
    return G.recommend_endpoint(G.endpoint_summary(d, o), slices, min_labels=2)


def _gates(stage, d, o, links, timed, slices):
    source = A.source_summary(d.select("recorded_at").unionByName(o.select("recorded_at")), kind=None)
    endpoint = G.recommend_endpoint(G.endpoint_summary(d, o), slices, min_labels=2)
    args = (G.readiness(_metrics(d, o, links)), source, G.dominant_version(d, "policy_version"),
            G.dominant_version(d, "model_version"), endpoint)
    if stage == "canary":
        return G.review_gates(*args)
    return G.review_gates(*args, "enforce", G.canary_comparison(d),
                          L.canary_challenge_budget(d, timed, F.col("last_us")), "canary-a")


@query
def d8_review_gates_canary(spark, sf):
    return _gates("canary", *_review_parts(spark, sf)).withColumn("position", F.col("position").cast("long"))


@query
def d8_review_gates_enforce(spark, sf):
    return _gates("enforce", *_review_parts(spark, sf)).withColumn("position", F.col("position").cast("long"))


def _proposal(spark, sf, stage):
    d, o, links, timed, slices = _review_parts(spark, sf)
    endpoint = G.recommend_endpoint(G.endpoint_summary(d, o), slices, min_labels=2)
    out = G.review_proposal(_gates(stage, d, o, links, timed, slices), endpoint, stage)
    return out.withColumns({c: F.col(c).cast("long") for c in ("basis_points", "duration_seconds")})


@query
def d8_proposal_canary(spark, sf):
    return _proposal(spark, sf, "canary")


@query
def d8_proposal_enforce(spark, sf):
    return _proposal(spark, sf, "enforce")


# --- H: telemetry ------------------------------------------------------------------------------

@query
def h1_traffic_counters(spark, sf):
    return M.traffic_counters(T.logged(spark, sf))


@query
def h2_reason_counters(spark, sf):
    doubled = T.logged(spark, sf).withColumn("reason_codes", F.concat("reason_codes", "reason_codes"))
    return M.reason_counters(doubled, 12)


@query
def h3_transport_posture(spark, sf):
    return M.transport_posture(T.requests(spark, sf))


@query
def h4_crawler_identity(spark, sf):
    return M.crawler_identity(T.requests(spark, sf))


@query
def h5_accept_coverage(spark, sf):
    return M.accept_coverage(T.coverage_reports(spark, sf)).select("source_id", "line_no", "verdict")


def _observer():
    return F.timestamp_micros(F.lit(T.T0 + 1800 * 1_000_000))


@query
def h6_origin_coverage(spark, sf):
    return M.origin_coverage(M.accept_coverage(T.coverage_reports(spark, sf)), _observer())


@query
def h6_coverage_state(spark, sf):
    accepted = M.accept_coverage(T.coverage_reports(spark, sf))
    return _round(M.coverage_state(M.origin_coverage(accepted, _observer()), accepted, _observer()))


@query
def h7_request_dispositions(spark, sf):
    return M.request_dispositions(T.request_log(spark, sf))


@query
def h7_running_dispositions(spark, sf):
    return M.running_dispositions(T.request_log(spark, sf)).select("line_no", "endpoint_class", *M.COUNTERS)


@query
def h8_collection_funnel(spark, sf):
    return _round(M.collection_funnel(T.request_log(spark, sf)))


@query
def h9_outcome_flow(spark, sf):
    return M.outcome_flow(T.request_log(spark, sf))


@query
def h10_latency_summary(spark, sf):
    return _round(M.latency_summary(T.request_log(spark, sf)))


@query
def h10_nearest_rank(spark, sf):
    return M.nearest_rank(T.request_log(spark, sf), "latency_us", keys=["source_id"])


@query
def h10_failure_counts(spark, sf):
    return M.failure_counts(T.request_log(spark, sf))


@query
def h10_run_spread(spark, sf):
    """Spread of the hourly median latency of each source."""
    hourly = M.nearest_rank(T.request_log(spark, sf).withColumn(
        "hour", F.floor(F.unix_micros("observed_at") / 3.6e9)), "latency_us", keys=["source_id", "hour"])
    return M.run_spread(hourly, "p50", ["source_id"])


# --- A: sources and sinks ------------------------------------------------------------------

@query
def a1_read_evidence_jsonl(spark, sf):
    """Write the rough evidence as JSON Lines, break some lines, read them strictly."""
    rough = stored(T.rough_local_events(spark, sf), "rough")
    e = F.col("line_no")
    text = F.to_json(F.struct(*[c for c in rough.columns if c != "line_no"]))
    broken = (F.when(e % 83 == 0, F.concat(text, F.lit(" x")))
              .when(e % 89 == 0, F.regexp_replace(text, "^.", '{"source":"access_gateway",'))
              .when(e % 97 == 0, F.regexp_replace(text, "^.", '{"extra":1,')).otherwise(text))
    folder = shared_folder(spark, "jsonl")
    rough.select(broken.alias("value")).write.text(folder)
    valid, bad = jsonl.read_evidence_jsonl(spark, folder)
    return _reasons(valid, bad)


def _published(spark, sf):
    folder = shared_folder(spark, "published")
    return folder, shards.publish_evidence(T.local_events(spark, sf), folder)


@query
def a4_publish_evidence(spark, sf):
    _, manifest = _published(spark, sf)
    return shards.published_summary(manifest).select("events", "first_us", "last_us")


@query
def a4_shard_contents(spark, sf):
    """Shards of at most 1,000 records: the rows in them by a digest that does not depend on files, their size and order."""
    folder = shared_folder(spark, "published")
    shards.publish_evidence(T.local_events(spark, sf), folder, shard_size=1_000)
    digest = shards.row_digest(F.col("line_no"), micros("observed_at"), F.col("subject_id"), F.col("session_id"), F.col("endpoint_class"))
    found = shards.shard_contents(spark, folder, digest)
    return found.select("records", "digest", (F.col("largest") > 1_000).alias("too_large"), "overlaps")


@query
def a5_verify_published(spark, sf):
    """Verification of a fresh folder: every shard matches, nothing is undeclared."""
    folder, manifest = _published(spark, sf)
    problems = shards.verify_published(spark, folder).agg(n().alias("problems"))
    return manifest.agg(F.sum("records").cast("long").alias("records")).crossJoin(problems)


@query
def a5_import_evidence(spark, sf):
    """The whole import of all valid records, written in order of time, and its verification."""
    rough = stored(T.rough_local_events(spark, sf), "rough").filter(A.evidence_reason().isNull())
    text = F.to_json(F.struct(*[c for c in rough.columns if c != "line_no"]))
    source, target = shared_folder(spark, "import-lines"), shared_folder(spark, "import-shards")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rough.repartitionByRange(parts, "observed_at", "line_no").sortWithinPartitions("observed_at", "line_no")
     .select(text.alias("value")).write.text(source))
    record = importer.import_evidence(spark, source, target, b"k" * 32, "dataset-a", "pilot-a")
    problems = importer.verify_import(spark, target).agg(n().alias("problems"))
    return record.select("dataset", "pilot", "domain_id", "schema_version", "events", "first_us", "last_us", "quarantined",
                         "out_of_order", F.size("warnings").cast("long").alias("warnings")).crossJoin(F.broadcast(problems))


@query
def a5_import_faults(spark, sf):
    """The whole rough table in its own order, faults and all: what was published, and the lines refused by reason."""
    rough = stored(T.rough_local_events(spark, sf), "rough")
    text = F.to_json(F.struct(*[c for c in rough.columns if c != "line_no"]))
    e = F.col("line_no")
    broken = F.when(e % 83 == 0, F.concat(text, F.lit(" x"))).when(e % 97 == 0, F.regexp_replace(text, "^.", '{"extra":1,')).otherwise(text)
    source, target = shared_folder(spark, "import-lines"), shared_folder(spark, "import-shards")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rough.withColumn("value", broken).repartitionByRange(parts, "line_no").sortWithinPartitions("line_no")
     .select("value").write.text(source))
    total = 2**62
    record = importer.import_evidence(spark, source, target, b"k" * 32, "dataset-a", "pilot-a", max_quarantined=total, max_out_of_order=total)
    return record.select("events", "quarantined", "out_of_order", F.inline("reasons"))


@query
def a13_sealed_records(spark, sf):
    """Encrypt, tamper with every 50th record, decrypt."""
    df = T.request_log(spark, sf).select(
        (F.col("line_no") % 5).cast("string").alias("source"), T.div(F.col("line_no"), 5).alias("seq"),
        "line_no", "disposition")
    box = sealed.encrypt_records(df, b"k" * 32).withColumn(
        "source", F.when(F.col("seq") % 50 == 7, F.lit("moved")).otherwise(F.col("source")))
    rows, _ = sealed.decrypt_records(box, b"k" * 32, "line_no long, disposition string")
    return rows.select("line_no", "disposition")


@query
def a13_check_counters(spark, sf):
    df = T.request_log(spark, sf).select((F.col("line_no") % 5).cast("string").alias("source"),
                                         T.div(F.col("line_no"), 5).alias("seq"))
    return sealed.check_counters(df.filter("NOT (source = '3' AND seq = 4)"))


@query
def a15_publish_report(spark, sf):
    """Two versions, both over the whole log; readers see the later one."""
    folder = shared_folder(spark, "report")
    flow = M.outcome_flow(T.request_log(spark, sf))
    for _ in range(2):
        reports.publish_report(flow, folder, replace=True)
    return reports.read_latest_report(spark, folder)


@query
def b3_assert_no_direct_refs(spark, sf):
    out = B.pseudonymise(T.local_events_raw(spark, sf), b"k" * 32, "dataset-a", "pilot-a")
    return B.assert_no_direct_refs(out).agg(
        n().alias("rows"), F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("session_id").alias("sessions"))


# --- J: streaming ---------------------------------------------------------------------------

def _stream(spark, sf, build) -> DataFrame:
    """Run a streaming operator over the events file to completion and read its sink.

    A separate session holds the state-store setting; the sink is in the shared folder. All input
    comes before its end, so no row is late and the columns of late rows are left out.
    """
    from ..streaming.ordered import LATE, PROVIDER, ROCKSDB

    session = spark.newSession()
    session.conf.set(PROVIDER, ROCKSDB)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "stream-checkpoint")
    df = build(session)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).drop(*LATE)


def _ended(stream: DataFrame, time: str, **values) -> DataFrame:
    """The stream and, from a source of its own, one row of the far future: the watermark then
    passes all real rows, so that open keys and windows of a finite input come out too."""
    spark, end = stream.sparkSession, F.lit("2200-01-01 00:00:00").cast("timestamp")
    values = {time: end, "line_no": -1, **values}
    row = spark.range(1).select(*[
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    folder = shared_folder(spark, "stream-end")
    row.write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(row.schema).parquet(folder))


def _staged(session, df: DataFrame, name: str) -> DataFrame:
    """A derived table as a stream over its files in the shared folder.

    A reader takes a row group whole and holds it twice, so they are small.
    """
    folder = shared_folder(session, name)
    df.write.option("parquet.block.size", 16 << 20).parquet(folder)
    return session.readStream.schema(df.schema).parquet(folder)


@query
def j1_stream_session_features(spark, sf):
    return _stream(spark, sf, lambda s: J.stream_session_features(
        _ended(T.request_stream(s, sf), "observed_at", session_id="end"), "0 seconds")).withColumn(
        "distinct_endpoint_classes", F.col("distinct_endpoint_classes").cast("long"))


@query
def j2_stream_event_batches(spark, sf):
    item = F.array(F.struct(F.lit(1).alias("sequence"), F.lit(0).alias("elapsed_bucket_ms"),
                            F.lit(V.BROWSER_EVENT_KINDS[0]).alias("kind"), F.lit(0).alias("value_bucket")))
    return _stream(spark, sf, lambda s: J.stream_event_batches(
        _ended(_staged(s, T.event_batches(spark, sf), "batches"), "received_at", session_id="end-of-stream",
               sensor_version="sensor-1", user_agent_present=True, verified_session=True, events=item), "0 seconds")).select(
        "line_no", "accepted_events", "total_accepted_events", "batch_sequence").filter("line_no >= 0")


@query
def j3_stream_single_use(spark, sf):
    signed = F.col("signature") == I.signature("payload", T.LOG_KEY)
    fault = I.proof_fault(F.col("well_formed"), signed)
    far = F.unix_micros(F.lit("2200-01-01 00:00:00").cast("timestamp"))

    def build(s):
        uses = T.proofs_of(T.event_stream(s, sf)).withColumn("fault", fault).select(
            "nonce", "line_no", "used_us", "expires_us", "fault")
        end = _ended(uses.withColumn("at", F.timestamp_micros("used_us")), "at", nonce="end", used_us=far, expires_us=far)
        return J.stream_single_use(end, F.col("fault"), "0 seconds")
    return _stream(spark, sf, build).select("line_no", "use")


@query
def j4_stream_windows(spark, sf):
    return _stream(spark, sf, lambda s: J.stream_windows(
        _ended(T.local_stream(s, sf), "observed_at", subject_id="end"), "0 seconds")).select(
        "sequence_key", "first_us", "last_us", "events", "peak_minute", "transitions", "closure")


@query
def j5_stream_link_outcomes(spark, sf):
    d = T.logged(spark, sf).filter("copy = 0").select("decision_id", "recorded_at", "endpoint_class")
    o = T.outcomes(T.logged(spark, sf)).filter("decision_id IS NOT NULL")
    return _stream(spark, sf, lambda s: J.stream_link_outcomes(
        _ended(_staged(s, d, "decisions"), "recorded_at", decision_id="end"),
        _ended(_staged(s, o, "outcomes"), "recorded_at", decision_id="end-outcome"), "15 minutes", "0 seconds", "0 seconds")).select(
        "decision_id", "outcome")


@query
def j6_stream_challenges(spark, sf):
    issued, events = T.challenges(spark, sf)
    first = issued.select("challenge_id", (F.col("ready_us") - 2_000_000).alias("us"), F.lit(-1).cast("long").alias("line_no"),
                          F.lit("issue").alias("kind"), F.lit(True).alias("ok"), "ready_us", "expires_us")
    none = F.lit(0).cast("long")
    rows = first.unionByName(events.withColumns({"ready_us": none, "expires_us": none}).select(*first.columns)).withColumn(
        "event_time", F.timestamp_micros("us"))
    far = F.unix_micros(F.lit("2200-01-01 00:00:00").cast("timestamp"))
    return _stream(spark, sf, lambda s: J.stream_challenges(_ended(
        _staged(s, rows, "challenges"), "event_time", challenge_id="end", us=far, kind="verify", ready_us=0, expires_us=0),
        "0 seconds")).select("challenge_id", "outcome")


@query
def j7_watch_report(spark, sf):
    """A report that a stream re-publishes as its append table grows; the newest version."""
    from ..streaming import jobs

    folder, report, mark = (shared_folder(spark, n) for n in ("watched", "watched-report", "watched-checkpoint"))
    log = T.logged(spark, sf)
    log.write.parquet(folder)
    stream = spark.readStream.schema(log.schema).parquet(folder)
    jobs.watch_report(stream, folder, G.decision_summary, report, mark, available_now=True).awaitTermination()
    return _round(reports.read_latest_report(spark, report))


@query
def j8_stream_coverage(spark, sf):
    return _stream(spark, sf, lambda s: J.stream_coverage(
        _ended(_staged(s, T.coverage_reports(spark, sf), "coverage"), "received_at", source_id="end"), "0 seconds"))


@query
def j9_stream_counters(spark, sf):
    stream = lambda s: _ended(T.request_stream(s, sf), "observed_at").withColumn(
        "computed_action", F.lit("allow"))
    df = _stream(spark, sf, lambda s: J.stream_counters(stream(s).withColumn("action", F.lit("allow")),
                                                        "5 minutes", "0 seconds", "observed_at"))
    return df.select(micros(F.col("window.start")).alias("start_us"), "decisions")


@query
def j10_route_late(spark, sf):
    """Odd events arrive first, even ones after them: even ones before the newest odd one are late."""
    from ..streaming import jobs

    folder, on_time, late, mark = (shared_folder(spark, n) for n in ("arrivals", "on-time", "late", "arrivals-checkpoint"))
    rows = T.requests(spark, sf).select("line_no", "observed_at")
    for part in (1, 0):
        rows.filter(F.col("line_no") % 2 == part).write.mode("append").parquet(folder)
        jobs.route_late(spark.readStream.schema(rows.schema).parquet(folder), "observed_at", 0, on_time, late, mark,
                        available_now=True).awaitTermination()
    return spark.read.parquet(on_time).select("line_no", F.lit(False).alias("late")).unionByName(
        spark.read.parquet(late).select("line_no", F.lit(True).alias("late")))
