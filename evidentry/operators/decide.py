"""The decision pipeline: features, detectors, scores, policy, mode, directive, replay."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import micros, optional_class
from ..functions.timeline import Timeline, over_timeline
from ..vocab import MICROS, MODEL_VERSION
from .detect import (Detector, add_signals, default_detectors, drop_signals, evidence_array,
                     select_detectors)
from .rollout import (CostContext, RolloutPlan, adapt_directive, add_rollout, cost_reasons,
                      cost_tier, directive_for, is_risky, suspicious_confidence)
from .score import PolicyBundle, apply_policy, pack_scores, scores_from_signals
from .session import SessionConfig, add_epochs, add_features, add_history

OVERRIDDEN = "SHADOW_ACTION_OVERRIDDEN"
DECISION_SECONDS = 30


@dataclass(frozen=True)
class DecisionConfig:
    """`mode` is shadow or enforce; a plan, when given, decides the mode per row."""

    mode: str = "shadow"
    plan: RolloutPlan | None = None
    cohort_key: bytes = b""
    policy: PolicyBundle = field(default_factory=PolicyBundle)
    enabled_detectors: tuple[str, ...] | None = None
    detectors: tuple[Detector, ...] | None = None
    model_version: str = MODEL_VERSION
    session: SessionConfig = field(default_factory=SessionConfig)


def score_requests(df: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Session features, evidence, scores, computed_action and policy_reason.

    One shuffle by session; everything after the windows is a narrow projection.
    """
    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        return add_features(add_epochs(d, line, config.session.ttl_us), line)

    df = over_timeline(df.withColumn("_us", micros("observed_at")), ["session_id"],
                       ["_us", "line_no"], apply, config.session.rows_per_chunk)
    return add_scores(df, config)


def add_scores(df: DataFrame, config: DecisionConfig) -> DataFrame:
    """Evidence, scores and policy for rows with session features and `_us`."""
    chosen = select_detectors(config.detectors or default_detectors(), config.enabled_detectors)
    df = add_signals(df, chosen)
    df = df.withColumns({"evidence": evidence_array(chosen), **scores_from_signals(chosen)})
    return pack_scores(apply_policy(drop_signals(df), config.policy))


def apply_shadow_mode(df: DataFrame, mode: str = "shadow") -> DataFrame:
    """Without a rollout plan: shadow turns risky actions into `observe`."""
    if mode not in ("shadow", "enforce"):
        raise ValueError(mode)
    overridden = is_risky(F.col("computed_action")) if mode == "shadow" else F.lit(False)
    return df.withColumns({
        "action": F.when(overridden, F.lit("observe")).otherwise(F.col("computed_action")),
        "mode": F.lit(mode),
        "rollout_id": F.lit(None).cast("string"),
        "rollout_reasons": F.array().cast("array<string>"),
    })


def _with_response(df: DataFrame, line: Timeline, config: DecisionConfig) -> DataFrame:
    """Directive and response history of rows whose action is known.

    The retry seconds depend on the history only through "retried too early once",
    which is sticky within an epoch. So the first early retry is found with the
    unscaled wait of the flag off, then the flag is switched on from there.
    """
    us, action, plan = F.col("_us"), F.col("action"), config.plan
    inside = F.col("mode") != "shadow"
    if plan is None:
        df = _history(df, line, directive_for(action, us))
        return df.withColumns({"directive": directive_for(action, us).struct(),
                               "response_cost_tier": F.lit(None).cast("int"),
                               "cost_reasons": F.array().cast("array<string>")})

    df = df.withColumn("_confidence", suspicious_confidence(F.col("evidence")))
    scaled = inside & action.isin("throttle", "block")

    def context(retried) -> CostContext:
        return CostContext(F.col("_confidence"), F.col("request_count"),
                           F.col("endpoint_transitions"), F.col("recent_enforcements"), retried)

    def directive(retried):
        planned, plain = directive_for(action, us, plan), directive_for(action, us)
        tier = cost_tier(F.col("endpoint_class"), context(retried))
        adapted = adapt_directive(planned, action, us, tier, plan)
        pick = lambda a, p: F.when(inside, a).otherwise(p)
        return replace(adapted, retry=pick(adapted.retry, plain.retry),
                       expires_us=pick(adapted.expires_us, plain.expires_us))

    # Pass 1: enforcement counts do not depend on the seconds; waits without the flag.
    df = _history(df, line, directive_for(action, us, plan))
    first = directive(F.lit(False))
    df = df.withColumns({"_retry": first.retry, "_expires": first.expires_us})
    df = add_history(df, line, first.handling, F.col("_retry"), F.col("_expires"))
    # Pass 2: the sticky flag is now exact, and so are the seconds.
    df = df.withColumn("_retried", F.col("premature_retries") >= 1)
    second = directive(F.col("_retried"))
    df = df.withColumns({"_retry": second.retry, "_expires": second.expires_us})
    df = add_history(df, line, second.handling, F.col("_retry"), F.col("_expires"))
    # Pass 3: exact counts.
    cost = context(F.col("_retried"))
    return df.withColumns({
        "directive": replace(second, retry=F.col("_retry"), expires_us=F.col("_expires")).struct(),
        "response_cost_tier": F.when(scaled, cost_tier(F.col("endpoint_class"), cost)),
        "cost_reasons": F.when(scaled, cost_reasons(F.col("endpoint_class"), cost))
                         .otherwise(F.array().cast("array<string>")),
    }).drop("_confidence", "_retry", "_expires", "_retried")


def _history(df: DataFrame, line: Timeline, d) -> DataFrame:
    return add_history(df, line, d.handling, d.retry, d.expires_us)


def decide(df: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Full decision rows for requests ordered by (observed_at, line_no) per session."""
    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        d = add_scores(add_features(add_epochs(d, line, config.session.ttl_us), line), config)
        if config.plan is None:
            d = apply_shadow_mode(d, config.mode)
            if config.mode == "shadow":  # every directive is `pass`: no history to track
                return _without_history(d)
        else:
            d = add_rollout(d, config.plan, config.cohort_key)
        return _with_response(d, line, config)

    df = over_timeline(df.withColumn("_us", micros("observed_at")), ["session_id"],
                       ["_us", "line_no"], apply, config.session.rows_per_chunk)
    return assemble_decisions(df, config).drop("_us", "cost_reasons", "rollout_reasons")


def _without_history(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "recent_enforcements": F.lit(0), "premature_retries": F.lit(0),
        "directive": directive_for(F.col("action"), F.col("_us")).struct(),
        "response_cost_tier": F.lit(None).cast("int"),
        "cost_reasons": F.array().cast("array<string>"),
    })


def assemble_decisions(df: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """reason_codes, versions and expiry of decision rows."""
    overridden = (F.col("mode") == "shadow") & is_risky(F.col("computed_action"))
    return df.withColumns({
        "reason_codes": F.concat(
            F.array("policy_reason"), F.col("rollout_reasons"), F.col("cost_reasons"),
            F.when(overridden, F.array(F.lit(OVERRIDDEN))).otherwise(F.array().cast("array<string>")),
            F.transform("evidence", lambda e: e.code)),
        "evaluation_cohort": optional_class("evaluation_cohort"),
        "policy_version": F.lit(config.policy.version),
        "model_version": F.lit(config.model_version),
        "expires_at": F.timestamp_micros(F.col("_us") + DECISION_SECONDS * MICROS),
    })


def replay(df: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Decisions with `matched`: both expected actions agree (absent = any)."""
    decided = decide(df, config)

    def agrees(expected: str, actual: str):
        want = F.coalesce(F.col(expected), F.lit(""))
        return (want == "") | (want == F.col(actual))

    return decided.withColumn("matched", agrees("expected_action", "action")
                              & agrees("expected_computed_action", "computed_action"))


def first_mismatch(replayed: DataFrame) -> DataFrame:
    """The earliest mismatching row, or nothing."""
    return (replayed.filter(~F.col("matched"))
            .agg(F.min(F.struct("observed_at", "line_no", "session_id", "expected_action",
                                "action", "expected_computed_action", "computed_action"))
                 .alias("r")).filter("r is not null").select("r.*"))


def event_shadow_decisions(receipts: DataFrame, action: str, endpoint_class: str,
                           config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Every accepted browser batch as a shadow decision.

    The request sequence is the batch sequence: event sequences jump by dozens and
    would look like missing requests.
    """
    if config.plan is None and config.mode == "enforce":
        config = replace(config, mode="shadow")
    nothing = F.lit("unknown")
    requests = receipts.select(
        F.col("received_at").alias("observed_at"), "line_no", "session_id",
        F.lit(action).alias("action"), F.lit(endpoint_class).alias("endpoint_class"),
        F.lit("unknown").alias("evaluation_cohort"),
        F.col("batch_sequence").alias("sequence"),
        F.struct(
            F.coalesce("user_agent_present", F.lit(False)).alias("user_agent_present"),
            F.col("total_accepted_events").cast("int").alias("browser_event_count"),
            F.lit(True).alias("browser_events_verified"),
            F.lit(0).alias("honeypot_hits"), F.lit(0).alias("verified_decoy_hits"),
            nothing.alias("challenge_verdict"), F.lit(0.0).alias("external_risk_score"),
            F.lit(False).alias("policy_alert"), F.lit(False).alias("verified_bot"),
            nothing.alias("crawler_class"), nothing.alias("crawler_verification"),
            nothing.alias("transport_protocol"), nothing.alias("transport_security"),
            nothing.alias("client_address_source"), nothing.alias("edge_fingerprint_class"),
            nothing.alias("edge_fingerprint_method"), nothing.alias("network_reputation"),
            nothing.alias("network_type"),
            F.coalesce("verified_session", F.lit(False)).alias("server_session_verified"),
        ).alias("observations"))
    decided = decide(requests, config)
    computed = F.col("computed_action")
    forced = F.when(computed == "allow", F.lit("allow")).otherwise(F.lit("observe"))
    absent = ~F.array_contains("reason_codes", OVERRIDDEN)
    once = F.when(is_risky(computed) & absent,
                  F.array_append("reason_codes", F.lit(OVERRIDDEN))
                  ).otherwise(F.col("reason_codes"))
    us = micros("observed_at")
    return decided.withColumns({
        "action": forced, "mode": F.lit("shadow"), "rollout_id": F.lit(None).cast("string"),
        "reason_codes": once, "directive": directive_for(forced, us).struct()})
