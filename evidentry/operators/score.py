"""Three-dimension score fusion and the ordered policy rules."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp01, let, round_half_up, sigmoid
from ..vocab import POLICY_VERSION
from .detect import Detector, obs, signals_of, verified_public_crawler

SCORES = ("automation_risk", "abuse_intent_risk", "account_continuity")


def _finish(automation: Column, intent: Column, continuity: Column) -> dict[str, Column]:
    return {
        "automation_risk": round_half_up(sigmoid(automation), 4),
        "abuse_intent_risk": round_half_up(sigmoid(intent), 4),
        "account_continuity": round_half_up(F.lit(1.0) - sigmoid(continuity), 4),
    }


def scores_from_signals(detectors: Iterable[Detector]) -> dict[str, Column]:
    """Scores as plain sums of CASE terms, which stay in generated code; needs
    `add_signals`.

    They are flat columns on purpose: fields of a struct would be inlined, and so
    evaluated again, at every place of use.
    """
    totals = {"automation": F.lit(0.0), "intent": F.lit(0.0), "continuity": F.lit(0.0)}
    for i, (_, s) in enumerate(signals_of(detectors)):
        weight = clamp01(s.strength_column.cast("double")) * min(max(s.confidence, 0.0), 1.0) * 2.0
        term = F.when(F.col(f"_fires_{i}"), weight * float(s.direction)).otherwise(F.lit(0.0))
        totals[s.dimension] = totals[s.dimension] + term
    return _finish(totals["automation"], totals["intent"], totals["continuity"])


def scores_from_evidence(evidence: Column) -> dict[str, Column]:
    """Scores of an evidence array, for evidence that arrives as data."""
    def total(dimension: str) -> Column:
        return F.aggregate(
            F.filter(evidence, lambda e: e.dimension == dimension), F.lit(0.0),
            lambda acc, e: acc + e.direction.cast("double") * clamp01(e.strength)
            * clamp01(e.confidence) * 2.0)

    return _finish(total("automation"), total("intent"), total("continuity"))


def fuse_scores(df: DataFrame) -> DataFrame:
    """Add the `scores` struct computed from the `evidence` array."""
    return pack_scores(df.withColumns(scores_from_evidence(F.col("evidence"))))


def pack_scores(df: DataFrame) -> DataFrame:
    """Replace the three flat score columns by the `scores` struct."""
    return df.withColumn("scores", F.struct(*SCORES)).drop(*SCORES)


@dataclass(frozen=True)
class PolicyBundle:
    """Thresholds of the policy rules (defaults are fixed values)."""

    automation_elevated: float = .52
    automation_step_up: float = .68
    automation_high: float = .88
    intent_elevated: float = .52
    intent_step_up: float = .68
    intent_high: float = .90
    continuity_step_up_below: float = .20
    version: str = POLICY_VERSION

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name != "version" and not .05 <= getattr(self, f.name) <= .99:
                raise ValueError(f"{f.name} is outside [0.05, 0.99]")
        if not (self.automation_elevated < self.automation_step_up < self.automation_high
                and self.intent_elevated < self.intent_step_up < self.intent_high):
            raise ValueError("thresholds must rise from elevated to high")

    def threshold(self, name: str) -> Column:
        """Thresholds take effect with two decimals."""
        return F.lit(round(float(f"{getattr(self, name):.2f}"), 2))


def decoy_hits() -> Column:
    """Claimed plus verified decoy hits, at most 100."""
    zero = F.lit(0)
    return F.least(F.coalesce(obs("honeypot_hits"), zero)
                   + F.coalesce(obs("verified_decoy_hits"), zero), F.lit(100))


# --- fixed values: outcome of each policy rule, in order -------------------------------
RULES = (
    ("block", "MULTI_SOURCE_ABUSE"),
    ("throttle", "PUBLIC_CONTENT_HIGH_RISK"),
    ("block", "HIGH_RISK"),
    ("challenge", "STEP_UP_REQUIRED"),
    ("delay", "ELEVATED_RISK"),
    ("allow", "VERIFIED_PUBLIC_CRAWLER_ALLOWED"),
    ("allow", "BASELINE_LOW_RISK"),
)


def matching_rule(bundle: PolicyBundle, scores: dict[str, Column], endpoint: Column,
                  hits: Column, alert: Column, crawler: Column) -> Column:
    """1-based number of the first matching rule in `RULES`.

    The inputs are bound once. However the optimizer inlines the result, the scores
    are not repeated for every threshold they are compared with.
    """
    t = bundle.threshold

    def choose(x: Column) -> Column:
        def over(level: str) -> Column:
            return (x.intent >= t(f"intent_{level}")) | (
                ~x.crawler & (x.automation >= t(f"automation_{level}")))

        step_up = x.alert | (x.hits >= 1) | (x.continuity < t("continuity_step_up_below"))
        return (F.when(x.alert & (x.hits >= 1), F.lit(1))
                .when((x.endpoint == "public_content") & over("high"), F.lit(2))
                .when(over("high"), F.lit(3))
                .when(step_up | over("step_up"), F.lit(4))
                .when(over("elevated"), F.lit(5))
                .when(x.crawler & ~x.alert & (x.hits == 0), F.lit(6))
                .otherwise(F.lit(7)))

    automation, intent, continuity = (scores[s] for s in SCORES)
    return let(F.struct(
        automation.alias("automation"), intent.alias("intent"), continuity.alias("continuity"),
        endpoint.alias("endpoint"), hits.alias("hits"), alert.alias("alert"),
        crawler.alias("crawler")), choose)


def apply_policy(df: DataFrame, bundle: PolicyBundle = PolicyBundle()) -> DataFrame:
    """Add `computed_action` and `policy_reason`.

    `df` carries the flat score columns or the `scores` struct.
    """
    flat = SCORES[0] in df.columns
    scores = {s: F.col(s if flat else f"scores.{s}") for s in SCORES}
    rule = matching_rule(bundle, scores, F.col("endpoint_class"), decoy_hits(),
                         F.coalesce(obs("policy_alert"), F.lit(False)), verified_public_crawler())
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in RULES]), F.col("_rule"))
    return (df.withColumn("_rule", rule)
            .withColumns({"computed_action": pick(0), "policy_reason": pick(1)}).drop("_rule"))
