"""Hand-computed expectations and brute-force folds on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidentry import schemas
from evidentry.functions.expr import base64url, hmac_sha256, proportion, wilson_lower, wilson_upper
from evidentry.functions.net import address_bits
from evidentry.operators import decide, detect, linkage, rollout, score, session, windows
from evidentry.plans import derived as T
from evidentry.vocab import ENDPOINT_CLASSES, MICROS, MINUTE_US

BASE = dict(user_agent_present=True, browser_event_count=0, browser_events_verified=False, honeypot_hits=0,
            verified_decoy_hits=0, challenge_verdict="unknown", external_risk_score=0.0, policy_alert=False,
            verified_bot=False, crawler_class="unknown", crawler_verification="unknown",
            transport_protocol="http2", transport_security="direct_tls", client_address_source="direct",
            edge_fingerprint_class="unknown", edge_fingerprint_method="unknown", network_reputation="unknown",
            network_type="unknown", server_session_verified=False)


def requests(spark, items):
    """items: (seconds, sequence, endpoint, observation changes)."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=t), i, "session-1", "read", ep, None, seq, Row(**{**BASE, **obs}), None, None)
            for i, (t, seq, ep, obs) in enumerate(items)]
    return spark.createDataFrame(rows, schemas.REQUEST)


def last(df, *columns):
    return tuple(df.orderBy("line_no").collect()[-1][c] for c in columns)


def test_wilson(spark):
    k, n = F.lit(5), F.lit(10)
    r = spark.range(1).select(proportion(k, n), wilson_lower(k, n), wilson_upper(k, n)).first()
    assert r[0] == 0.5 and abs(r[1] - 0.236593090512564) < 1e-12 and abs(r[2] - 0.763406909487436) < 1e-12
    zero = spark.range(1).select(proportion(F.lit(3), F.lit(0)), wilson_upper(F.lit(3), F.lit(2))).first()
    assert tuple(zero) == (0.0, 0.0)


def test_hmac_and_base64url(spark):
    import base64
    import hashlib
    import hmac

    for key in (b"short", b"x" * 100):
        got = spark.range(1).select(base64url(hmac_sha256(key, F.lit("message").cast("binary")))).first()[0]
        want = hmac.new(key, b"message", hashlib.sha256).digest()
        assert got == base64.urlsafe_b64encode(want).decode().rstrip("=")


@pytest.mark.parametrize("count,seconds,action", [(41, 30, "allow"), (100, 120, "delay"), (100, 30, "challenge")])
def test_velocity(spark, count, seconds, action):
    items = [(seconds * i / (count - 1), i + 1, "account", {}) for i in range(count)]
    config = decide.DecisionConfig(enabled_detectors=("sequence_velocity_v2",))
    assert last(decide.decide(requests(spark, items), config), "computed_action") == (action,)


def test_sequence_gap(spark):
    df = session.session_features(requests(spark, [(0, 1, "account", {}), (1, 5, "account", {})]))
    assert last(df, "request_count", "max_sequence_gap") == (2, 3)


def test_late_row_leaves_navigation_alone(spark):
    path = ["public_content", "compare_index", "public_content", "account", "account", "login"]
    items = [(i, i + 1, ep, {}) for i, ep in enumerate(path)] + [(7, 2, "checkout", {})]
    df = session.session_features(requests(spark, items))
    assert last(df, "distinct_endpoint_classes", "endpoint_transitions") == (4, 4)


def test_epoch_boundary_is_strict(spark):
    df = session.session_features(requests(spark, [(0, 1, "account", {}), (300, 2, "account", {}), (600.000001, 3, "account", {})]))
    assert [r.epoch for r in df.orderBy("line_no").collect()] == [1, 1, 2]


def test_retry_history(spark):
    df = requests(spark, [(0, 1, "account", {}), (1, 2, "account", {}), (6, 3, "account", {}), (366, 4, "account", {})])
    throttle = (F.col("line_no") < 2)
    df = df.withColumn("directive", F.struct(
        F.when(throttle, F.lit("throttle")).otherwise(F.lit("pass")).alias("handling"),
        F.when(throttle, 5).otherwise(0).alias("retry_after_seconds"),
        (F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).alias("expires_at")))
    got = session.enforcement_history(df).orderBy("line_no").collect()
    assert [(r.recent_enforcements, r.premature_retries) for r in got] == [(0, 0), (1, 1), (2, 1), (0, 0)]


def test_policy_order(spark):
    items = [(0, 1, "account", {"policy_alert": True, "honeypot_hits": 1}),
             (1, 2, "account", {"honeypot_hits": 1}),
             (2, 3, "public_content", {"verified_bot": True, "crawler_class": "preview",
                                       "crawler_verification": "http_signature"}),
             (3, 4, "account", {"user_agent_present": False, "browser_events_verified": True,
                                "browser_event_count": 3, "challenge_verdict": "failed"})]
    got = [r.policy_reason for r in decide.decide(requests(spark, items)).orderBy("line_no").collect()]
    assert got == ["MULTI_SOURCE_ABUSE", "STEP_UP_REQUIRED", "VERIFIED_PUBLIC_CRAWLER_ALLOWED", "HIGH_RISK"]


def test_config_checks():
    with pytest.raises(ValueError):
        score.PolicyBundle(automation_elevated=.70)
    with pytest.raises(ValueError):
        detect.select_detectors(detect.default_detectors(), ["campaign_surface_v1", "campaign_surface_v1"])
    with pytest.raises(ValueError):
        detect.select_detectors(detect.default_detectors(), ["nope_v1"])
    with pytest.raises(ValueError):
        rollout.RolloutPlan("canary-a", "canary", ("account",), "throttle", 0, 10 * MICROS)


def test_user_detector(spark):
    mine = detect.Detector("night_owl_v1", (detect.Signal("NIGHT", "intent", 1, .9, .9, F.hour("observed_at") < 5),))
    config = decide.DecisionConfig(detectors=(*detect.default_detectors(), mine), enabled_detectors=("night_owl_v1",))
    r = decide.decide(requests(spark, [(0, 1, "account", {})]), config).first()
    assert r.reason_codes[-1] == "NIGHT" and r.computed_action == "challenge"


@pytest.mark.parametrize("tier,seconds", [(0, 60), (1, 195), (2, 330), (3, 465), (4, 600)])
def test_scaled_seconds(spark, tier, seconds):
    assert spark.range(1).select(rollout.scaled_seconds(F.lit(60), F.lit(600), F.lit(tier))).first()[0] == seconds


@pytest.mark.parametrize("text,bits", [
    ("192.0.2.1", f"{0xC0000201:032b}"), ("::ffff:192.0.2.1", f"{0xC0000201:032b}"), ("::1", f"{1:0128b}"),
    ("2001:db8::5", f"{0x20010db8 << 96 | 5:0128b}"), ("256.0.0.1", None), ("1:2:3", None), ("::1%eth0", None),
    ("1::2::3", None), ("01.2.3.4", None)])
def test_addresses(spark, text, bits):
    assert spark.range(1).select(address_bits(F.lit(text))).first()[0] == bits


def local(spark, times, key="k"):
    return spark.createDataFrame([(i, t, key, "api") for i, t in enumerate(times)],
                                 "line_no long, us long, sequence_key string, endpoint_class string").withColumn(
        "observed_at", F.timestamp_micros("us"))


def test_window_cap(spark):
    df = windows.sequence_windows(local(spark, [m * MINUTE_US for m in (0, 4, 8, 12, 15)]))
    assert [r.window_us // MINUTE_US for r in df.orderBy("line_no").collect()] == [0, 0, 0, 0, 15]


def test_window_gap_is_inclusive(spark):
    df = windows.sequence_windows(local(spark, [0, 5 * MINUTE_US, 10 * MINUTE_US - 1]))
    assert [r.window_us for r in df.orderBy("line_no").collect()] == [0, 5 * MINUTE_US, 5 * MINUTE_US]


def test_windows_against_fold(spark):
    rng = random.Random(7)
    for _ in range(3):
        times, t = [], 0
        for _ in range(300):
            t += rng.choice([1, 20, 60, 200, 299, 300, 301]) * MICROS
            times.append(t)
        want, start, prev = [], None, None
        for t in times:
            if start is None or t - prev >= 5 * MINUTE_US or t - start >= 15 * MINUTE_US:
                start = t
            prev = t
            want.append(start)
        got = windows.sequence_windows(local(spark, times)).orderBy("line_no").collect()
        assert [r.window_us for r in got] == want


def test_features_against_fold(spark):
    rng = random.Random(3)
    items, t = [], 0.0
    for i in range(200):
        t += rng.choice([0, 1, 30, 299, 301])
        items.append((t, rng.randint(1, 60), rng.choice(ENDPOINT_CLASSES), {}))
    want, s = [], None
    for t, seq, ep, _ in items:
        if s is None or t - s["t"] > 300:
            s = dict(n=0, seq=0, gap=0, seen=set(), moves=0, at=None)
        s["t"], s["n"] = t, s["n"] + 1
        if s["seq"] and seq > s["seq"]:
            s["gap"] = max(s["gap"], seq - s["seq"] - 1)
        if seq > s["seq"]:
            s["seen"].add(ep)
            s["moves"] += s["at"] not in (None, ep)
            s["at"], s["seq"] = ep, seq
        want.append((s["n"], s["gap"], len(s["seen"]), s["moves"]))
    got = session.session_features(requests(spark, items)).orderBy("line_no").collect()
    assert [(r.request_count, r.max_sequence_gap, r.distinct_endpoint_classes, r.endpoint_transitions)
            for r in got] == want


def test_linkage_is_order_independent(spark, sf):
    from evidentry.functions.timeline import durable

    d = durable(T.logged(spark, sf))
    o = T.outcomes(d)
    a = linkage.linkage_summary(linkage.link_outcomes(d, o), o).first()
    mixed = d.orderBy(F.rand(5)).repartition(7), o.orderBy(F.rand(6)).repartition(3)
    assert linkage.linkage_summary(linkage.link_outcomes(*mixed), mixed[1]).first() == a


def test_corrupted_reports_are_found(spark, sf):
    """Every check that recomputes must reject a report with one wrong number."""
    from evidentry.operators import analysis, holdout
    from evidentry.plans import catalog

    w = catalog._split(spark, sf)
    report, confusion = holdout.holdout_report(w), holdout.rule_confusion(w)
    failed = lambda r, c: {x["check_name"] for x in holdout.check_holdout_report(r, c).collect() if not x["ok"]}
    assert failed(report, confusion) == set()
    more = lambda df, c, n=1: df.withColumn(c, F.coalesce(F.col(c), F.lit(0)) + n)
    assert "rates_recomputed" in failed(report, more(confusion, "abuse_capture_rate", 0.01))
    assert "labels_are_the_reports" in failed(more(report, "holdout_human_confirmed"), confusion)
    one = F.when(F.col("endpoint_class") == "api", 10**6).otherwise(0)
    assert "endpoints_within_all" in failed(report, more(confusion, "flagged_unknown", one))
    budget = analysis.distinct_budget(spark.range(300).select(F.col("id").cast("string").alias("v")), ("v",))
    with pytest.raises(Exception, match="too many distinct values"):
        analysis.enforce_distinct_budget(budget).collect()
