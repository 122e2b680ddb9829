"""Canary bucketing, enforcement directives, adaptive response cost and review gates."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import concat_bytes, hmac_sha256, present, utf8
from ..vocab import ACTIONS, MICROS, RISKY_ACTIONS, ROLLOUT_ENDPOINTS, ROLLOUT_ID

# --- fixed values: response durations and response-cost reasons --------------------
FULL_BASIS_POINTS = 10_000
MAX_CANARY_BASIS_POINTS = 1000
PASS_SECONDS = 30
DELAY_SECONDS = 1
THROTTLE_SECONDS = 5
CHALLENGE_SECONDS = 300
BLOCK_SECONDS = 300
MAX_TIER = 4
COST_ENDPOINT = "RESPONSE_COST_ENDPOINT_VALUE"
COST_EVIDENCE = "RESPONSE_COST_CONFIDENT_EVIDENCE"
COST_BEHAVIOR = "RESPONSE_COST_RECENT_BEHAVIOR"
COST_RETRY = "RESPONSE_COST_RETRY_HISTORY"
COST_BASELINE = "RESPONSE_COST_BASELINE"

DIRECTIVE_TYPE = ("struct<handling:string,http_status:int,retry_after_seconds:int,"
                  "expires_at:timestamp>")


@dataclass(frozen=True)
class RolloutPlan:
    """A bounded, reversible rollout. Times are epoch microseconds."""

    rollout_id: str
    stage: str
    endpoint_classes: tuple[str, ...]
    max_action: str
    created_us: int
    expires_us: int
    canary_basis_points: int = 100
    throttle_seconds: int = THROTTLE_SECONDS
    challenge_seconds: int = CHALLENGE_SECONDS
    block_seconds: int = BLOCK_SECONDS
    predecessor_rollout_id: str = ""
    cohort_label: bytes = b"evidentry:rollout-cohort:v1"

    def __post_init__(self) -> None:
        day_us = 86_400 * MICROS
        length = self.expires_us - self.created_us
        ok = bool(re.match(ROLLOUT_ID, self.rollout_id)) and length > 0
        if self.stage == "canary":
            ok &= (length <= 7 * day_us and 1 <= self.canary_basis_points <= MAX_CANARY_BASIS_POINTS
                   and self.max_action in ("delay", "throttle", "challenge")
                   and self.predecessor_rollout_id == "")
        elif self.stage == "enforce":
            ok &= (length <= day_us and self.canary_basis_points == FULL_BASIS_POINTS
                   and self.max_action in RISKY_ACTIONS
                   and bool(re.match(ROLLOUT_ID, self.predecessor_rollout_id)))
        else:
            ok = False
        ok &= 1 <= self.throttle_seconds <= 60 and 30 <= self.challenge_seconds <= 900
        ok &= 60 <= self.block_seconds <= 3600
        scope = self.endpoint_classes
        ok &= 1 <= len(scope) <= 4 and list(scope) == sorted(set(scope))
        ok &= set(scope) <= set(ROLLOUT_ENDPOINTS)
        if not ok:
            raise ValueError("invalid rollout plan")


def canary_bucket(session: Column, rollout_id: str, key: bytes,
                  label: bytes = b"evidentry:rollout-cohort:v1") -> Column:
    """Stable bucket 0..9999 of a session, from two HMAC bytes."""
    message = concat_bytes(F.lit(bytearray(label + b"\0" + rollout_id.encode() + b"\0")),
                           utf8(session))
    head = F.substring(F.hex(hmac_sha256(key, message)), 1, 4)
    return (F.conv(head, 16, 10).cast("int") % FULL_BASIS_POINTS).cast("int")


def is_risky(action: Column) -> Column:
    return action.isin(*RISKY_ACTIONS)


def action_rank(action: Column) -> Column:
    expr = F.lit(0)
    for i, a in enumerate(ACTIONS):
        expr = F.when(action == a, F.lit(i)).otherwise(expr)
    return expr


@dataclass(frozen=True)
class DirectiveColumns:
    handling: Column
    http_status: Column
    retry: Column
    expires_us: Column

    def struct(self) -> Column:
        return F.struct(
            self.handling.alias("handling"), self.http_status.alias("http_status"),
            self.retry.cast("int").alias("retry_after_seconds"),
            F.timestamp_micros(self.expires_us).alias("expires_at"))


def directive_for(action: Column, us: Column, plan: RolloutPlan | None = None) -> DirectiveColumns:
    """What the origin is told to do for an action, clipped at the plan's expiry."""
    def pick(delay, throttle, challenge, block, other) -> Column:
        return (F.when(action == "delay", F.lit(delay)).when(action == "throttle", F.lit(throttle))
                .when(action == "challenge", F.lit(challenge)).when(action == "block", F.lit(block))
                .otherwise(F.lit(other)))

    throttle = plan.throttle_seconds if plan else THROTTLE_SECONDS
    challenge = plan.challenge_seconds if plan else CHALLENGE_SECONDS
    block = plan.block_seconds if plan else BLOCK_SECONDS
    seconds = pick(DELAY_SECONDS, throttle, challenge, block, PASS_SECONDS)
    retry = pick(DELAY_SECONDS, throttle, 0, block, 0)
    expires = us + seconds.cast("long") * MICROS
    retry, expires = _clip(retry, expires, us, plan)
    return DirectiveColumns(
        pick("delay", "throttle", "challenge", "block", "pass"),
        pick(429, 429, 403, 403, 200), retry, expires)


def _clip(retry: Column, expires: Column, us: Column, plan: RolloutPlan | None):
    if plan is None:
        return retry, expires
    end = F.lit(plan.expires_us).cast("long")
    left = F.greatest(F.floor((end - us) / float(MICROS)).cast("int"), F.lit(1))
    clipped = F.when((end < expires) & (retry > 0), F.least(retry, left)).otherwise(retry)
    return clipped, F.least(expires, end)


def suspicious_confidence(evidence: Column) -> Column:
    """Highest confidence of suspicious evidence with strength of at least one half."""
    strong = F.filter(evidence, lambda e: (e.direction == 1) & e.strength.between(0.5, 1.0)
                      & e.confidence.between(0.0, 1.0))
    return F.coalesce(F.array_max(F.transform(strong, lambda e: e.confidence)), F.lit(0.0))


@dataclass(frozen=True)
class CostContext:
    """Inputs of the response cost. `retried` is 'premature retries >= 1'."""

    confidence: Column
    request_count: Column
    transitions: Column
    recent: Column
    retried: Column


def cost_flags(endpoint: Column, c: CostContext) -> list[tuple[Column, str]]:
    return [
        (endpoint.isin("compare_index", "compare_noindex"), COST_ENDPOINT),
        (c.confidence.between(0.75, 1.0), COST_EVIDENCE),
        ((c.request_count >= 50) | (c.transitions >= 6), COST_BEHAVIOR),
        ((c.recent >= 2) | c.retried, COST_RETRY),
    ]


def cost_tier(endpoint: Column, c: CostContext) -> Column:
    tier = F.lit(0)
    for flag, _ in cost_flags(endpoint, c):
        tier = tier + F.coalesce(flag, F.lit(False)).cast("int")
    return tier


def cost_reasons(endpoint: Column, c: CostContext) -> Column:
    hits = present(*[F.when(flag, F.lit(reason)) for flag, reason in cost_flags(endpoint, c)])
    return F.when(F.size(hits) == 0, F.array(F.lit(COST_BASELINE))).otherwise(hits)


def scaled_seconds(low: Column, high: Column, tier: Column) -> Column:
    """Ceiling interpolation between two durations over the tiers."""
    steps = F.floor(((high - low) * tier + (MAX_TIER - 1)) / float(MAX_TIER)).cast("int")
    return (F.when((high <= low) | (tier <= 0), low)
            .when(tier >= MAX_TIER, high).otherwise(low + steps))


def adapt_directive(d: DirectiveColumns, action: Column, us: Column, tier: Column,
                    plan: RolloutPlan) -> DirectiveColumns:
    """Scale throttle and block by the cost tier; other directives stay as they are."""
    low = F.when(action == "throttle", F.lit(1)).otherwise(F.lit(60))
    retry = scaled_seconds(low, d.retry, tier)
    expires = us + retry.cast("long") * MICROS
    retry, expires = _clip(retry, expires, us, plan)
    scaled = action.isin("throttle", "block")
    return DirectiveColumns(
        d.handling, d.http_status, F.when(scaled, retry).otherwise(d.retry),
        F.when(scaled, expires).otherwise(d.expires_us))


def add_rollout(df: DataFrame, plan: RolloutPlan, key: bytes) -> DataFrame:
    """Add action, mode, rollout_id and `rollout_reasons` (before response cost).

    Needs `_us`, `session_id`, `endpoint_class` and `computed_action`.
    """
    us, computed = F.col("_us"), F.col("computed_action")
    excluded = (F.when(us >= plan.expires_us, F.lit("ROLLOUT_EXPIRED"))
                .when(~F.col("endpoint_class").isin(*plan.endpoint_classes),
                      F.lit("ROLLOUT_ENDPOINT_EXCLUDED")))
    if plan.stage == "canary":
        bucket = canary_bucket(F.col("session_id"), plan.rollout_id, key, plan.cohort_label)
        excluded = excluded.when(bucket >= plan.canary_basis_points, F.lit("ROLLOUT_CANARY_EXCLUDED"))
    df = df.withColumn("_excluded", excluded)
    capped = is_risky(computed) & (action_rank(computed) > ACTIONS.index(plan.max_action))
    outside = F.col("_excluded").isNotNull()
    action = (F.when(outside & is_risky(computed), F.lit("observe")).when(outside, computed)
              .when(capped, F.lit(plan.max_action)).otherwise(computed))
    reasons = present(F.col("_excluded"),
                      F.when(~outside & capped, F.lit("ROLLOUT_ACTION_CAPPED")))
    return df.withColumns({
        "action": action,
        "mode": F.when(outside, F.lit("shadow")).otherwise(F.lit(plan.stage)),
        "rollout_id": F.lit(plan.rollout_id),
        "rollout_reasons": reasons,
    }).drop("_excluded")


def apply_rollout(df: DataFrame, plan: RolloutPlan, key: bytes) -> DataFrame:
    """Rollout of scored requests: action, mode, rollout_id, rollout_reasons."""
    from ..functions.expr import micros
    return add_rollout(df.withColumn("_us", micros("observed_at")), plan, key).drop("_us")


def directive(df: DataFrame, plan: RolloutPlan | None = None, action: str = "action") -> DataFrame:
    """Add the unscaled `directive` struct of an action column."""
    from ..functions.expr import micros
    return df.withColumn(
        "directive", directive_for(F.col(action), micros("observed_at"), plan).struct())


def plan_times(created: str, expires: str) -> tuple[int, int]:
    """Epoch microseconds of two `YYYY-MM-DDTHH:MM:SSZ` strings."""
    def us(text: str) -> int:
        parsed = dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.timezone.utc)
        return int(parsed.timestamp()) * MICROS
    return us(created), us(expires)
