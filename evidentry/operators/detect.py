"""Transparent detectors: conditions over a scored request and their constants."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp01, is_finite, present
from ..vocab import (BENEFICIAL_CRAWLERS, CRAWLER_CLASSES, CRAWLER_VERIFICATIONS, DETECTOR_ID,
                     EVIDENCE_CODE, MINUTE_US, PUBLIC_CRAWLER_ENDPOINTS)

EVIDENCE_TTL_SECONDS = 300
DIMENSIONS = ("automation", "intent", "continuity")
EVIDENCE_TYPE = ("array<struct<code:string,detector:string,dimension:string,direction:int,"
                 "strength:double,confidence:double,ttl_seconds:int>>")


def obs(name: str) -> Column:
    return F.col(f"observations.{name}")


@dataclass(frozen=True)
class Signal:
    """One kind of evidence. `direction` is +1 (suspicious) or -1 (benign)."""

    code: str
    dimension: str
    direction: int
    strength: float | Column
    confidence: float
    when: Column

    @property
    def strength_column(self) -> Column:
        return self.strength if isinstance(self.strength, Column) else F.lit(self.strength)

    @property
    def fires(self) -> Column:
        return F.coalesce(self.when, F.lit(False))


@dataclass(frozen=True)
class Detector:
    """A named group of signals. User detectors are built the same way."""

    id: str
    signals: tuple[Signal, ...] = field(default_factory=tuple)


def verified_public_crawler() -> Column:
    """The only gate that lets beneficial automation lower the automation risk."""
    return F.coalesce(
        obs("verified_bot")
        & F.col("endpoint_class").isin(*PUBLIC_CRAWLER_ENDPOINTS)
        & obs("crawler_verification").isin(*[v for v in CRAWLER_VERIFICATIONS if v != "unknown"])
        & obs("crawler_class").isin(*BENEFICIAL_CRAWLERS),
        F.lit(False))


def default_detectors() -> tuple[Detector, ...]:
    """The built-in registry, in evaluation order (it fixes evidence order).

    Codes, dimensions, strengths, confidences and thresholds are fixed values.
    """
    ua = F.coalesce(obs("user_agent_present"), F.lit(False))
    verified_events = F.when(obs("browser_events_verified"), obs("browser_event_count")).otherwise(0)
    duration = F.col("_us") - F.col("first_seen_us")
    count, gap = F.col("request_count"), F.col("max_sequence_gap")
    claimed, redeemed = obs("honeypot_hits"), obs("verified_decoy_hits")
    verdict = F.lower(F.regexp_replace(obs("challenge_verdict"), r"^\s+|\s+$", ""))
    risk = obs("external_risk_score")
    fingerprint, reputation, network = (
        obs("edge_fingerprint_class"), obs("network_reputation"), obs("network_type"))

    def more(base: float, n: Column) -> Column:
        return clamp01(F.lit(base) + F.lit(0.12) * (n - 1).cast("double"))

    return (
        Detector("protocol_consistency_v2", (
            Signal("UA_MISSING", "automation", 1, .52, .72, ~ua),
            Signal("BROWSER_PROTOCOL_CONTRADICTION", "automation", 1, .82, .90,
                   (verified_events > 0) & ~ua),
            Signal("BROWSER_SEQUENCE_PRESENT", "continuity", -1, .24, .64,
                   (verified_events >= 3) & ua),
            Signal("SERVER_SESSION_VERIFIED", "continuity", -1, .30, .95,
                   obs("server_session_verified")),
        )),
        Detector("sequence_velocity_v2", (
            Signal("SESSION_VOLUME_HIGH", "intent", 1, .54, .58, count >= 100),
            Signal("SESSION_BURST_FAST", "intent", 1, .56, .60,
                   (count >= 50) & duration.between(0, MINUTE_US)),
            Signal("SEQUENCE_GAP_HIGH", "automation", 1, .56, .70, gap > 20),
            Signal("SESSION_SEQUENCE_STABLE", "continuity", -1, .18, .60, (count > 1) & (gap <= 2)),
        )),
        Detector("navigation_graph_v1", (
            Signal("NAVIGATION_SURFACE_SWEEP", "intent", 1, .42, .45,
                   (F.col("distinct_endpoint_classes") >= 5)
                   & (F.col("endpoint_transitions") >= 6)
                   & duration.between(0, 2 * MINUTE_US)),
        )),
        Detector("decoy_interaction_v2", (
            Signal("HONEYPOT_INTERACTION", "intent", 1, more(.62, claimed), .88, claimed > 0),
            Signal("DECOY_CAPABILITY_REDEEMED", "intent", 1, more(.72, redeemed), .94, redeemed > 0),
        )),
        Detector("campaign_surface_v1", (
            Signal("COMPARE_NOINDEX_CAMPAIGN_SURFACE", "intent", 1, .51, .75,
                   F.col("endpoint_class") == "compare_noindex"),
        )),
        Detector("external_verdicts_v3", (
            Signal("CHALLENGE_VERDICT_SUSPICIOUS", "automation", 1, .74, .78,
                   verdict.isin("suspicious", "failed", "blocked")),
            Signal("EXTERNAL_RISK", "intent", 1, clamp01(risk), .72, risk > 0),
            Signal("POLICY_ALERT", "intent", 1, .82, .86, obs("policy_alert")),
            Signal("VERIFIED_PUBLIC_CRAWLER", "automation", -1, .68, .92, verified_public_crawler()),
        )),
        Detector("edge_intelligence_v1", (
            Signal("EDGE_AUTOMATION_PROFILE", "automation", 1, .58, .72,
                   fingerprint == "automation_consistent"),
            Signal("EDGE_PROTOCOL_ANOMALY", "automation", 1, .48, .62, fingerprint == "anomalous"),
            Signal("NETWORK_REPUTATION_ELEVATED", "intent", 1, .46, .58,
                   reputation == "elevated_risk"),
            Signal("NETWORK_REPUTATION_HIGH", "intent", 1, .72, .76, reputation == "high_risk"),
            Signal("NETWORK_HOSTING_CONTEXT", "automation", 1, .28, .40, network == "hosting"),
            Signal("NETWORK_ANONYMIZER_CONTEXT", "automation", 1, .32, .44, network == "anonymizer"),
        )),
    )


def select_detectors(detectors: Iterable[Detector], enabled: Iterable[str] | None) -> tuple[Detector, ...]:
    """Check a registry and keep the enabled ids, in the order they were enabled."""
    by_id: dict[str, Detector] = {}
    for d in detectors:
        if not re.match(DETECTOR_ID, d.id) or d.id in by_id:
            raise ValueError(f"invalid or repeated detector id: {d.id!r}")
        if len(d.signals) > 32:
            raise ValueError(f"detector {d.id} declares more than 32 signals")
        for s in d.signals:
            if not re.match(EVIDENCE_CODE, s.code) or s.dimension not in DIMENSIONS \
                    or s.direction not in (-1, 1):
                raise ValueError(f"detector {d.id} declares an invalid signal {s.code!r}")
        by_id[d.id] = d
    if len(by_id) > 32:
        raise ValueError("more than 32 detectors")
    if enabled is None:
        return tuple(by_id.values())
    wanted = list(enabled)
    if not wanted or len(set(wanted)) != len(wanted) or not set(wanted) <= set(by_id):
        raise ValueError(f"unknown or repeated detector ids: {wanted}")
    return tuple(by_id[i] for i in wanted)


def signals_of(detectors: Iterable[Detector]) -> list[tuple[str, Signal]]:
    return [(d.id, s) for d in detectors for s in d.signals]


def add_signals(df: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """One boolean column `_fires_<i>` per signal, so each condition runs once."""
    return df.withColumns({f"_fires_{i}": s.fires for i, (_, s) in enumerate(signals_of(detectors))})


def drop_signals(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_fires_")])


def evidence_array(detectors: Iterable[Detector]) -> Column:
    """Ordered array of the evidence that fires; needs `add_signals`.

    The constants of all signals are one literal array. Only the positions that fire
    are computed per row.
    """
    signals = signals_of(detectors)
    constants = F.array(*[F.struct(
        F.lit(s.code).alias("code"), F.lit(det).alias("detector"),
        F.lit(s.dimension).alias("dimension"), F.lit(s.direction).alias("direction"),
        F.lit(s.confidence).alias("confidence")) for det, s in signals])
    strengths = F.array(*[s.strength_column.cast("double") for _, s in signals])
    fired = present(*[F.when(F.col(f"_fires_{i}"), F.lit(i + 1)) for i in range(len(signals))])

    def item(i: Column) -> Column:
        c = F.element_at(constants, i)
        return F.struct(
            c.code.alias("code"), c.detector.alias("detector"), c.dimension.alias("dimension"),
            c.direction.alias("direction"), F.element_at(strengths, i).alias("strength"),
            c.confidence.alias("confidence"), F.lit(EVIDENCE_TTL_SECONDS).alias("ttl_seconds"))

    return F.transform(fired, item)


def detect(df: DataFrame, detectors: Iterable[Detector] | None = None,
           enabled: Iterable[str] | None = None) -> DataFrame:
    """Add the `evidence` array; `df` carries session features and `_us`."""
    chosen = select_detectors(detectors or default_detectors(), enabled)
    return drop_signals(add_signals(df, chosen).withColumn("evidence", evidence_array(chosen)))


def valid_evidence(evidence: Column | str = "evidence") -> Column:
    """Contract of evidence rows that come from outside the built-in registry."""
    evidence = F.col(evidence) if isinstance(evidence, str) else evidence

    def ok(e: Column) -> Column:
        return (e.detector.rlike(DETECTOR_ID) & e.code.rlike(EVIDENCE_CODE)
                & e.dimension.isin(*DIMENSIONS) & e.direction.isin(-1, 1)
                & is_finite(e.strength) & e.strength.between(0, 1)
                & is_finite(e.confidence) & e.confidence.between(0, 1)
                & (e.ttl_seconds > 0) & (e.ttl_seconds <= 86_400))

    per_detector = F.forall(
        F.array_distinct(F.transform(evidence, lambda e: e.detector)),
        lambda d: F.size(F.filter(evidence, lambda e: e.detector == d)) <= 32)
    return F.coalesce((F.size(evidence) <= 128) & F.forall(evidence, ok) & per_detector, F.lit(False))


def validate_evidence_rows(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Add `evidence_valid`."""
    return df.withColumn("evidence_valid", valid_evidence(evidence))


def crawler_class_known(c: Column) -> Column:
    return c.isin(*[v for v in CRAWLER_CLASSES if v != "unknown"])
