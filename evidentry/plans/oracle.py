"""Equivalent DuckDB SQL of the registered queries, written independently of Spark.

`VIEWS` are named building blocks; `sql(text)` prefixes a query with the blocks it
uses, in dependency order.
"""

from __future__ import annotations

import re

from .. import vocab as V
from ..operators.pseudonym import domain_id, domain_key

VIEWS: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def sql(text: str) -> str:
    """`text` with the needed views as common table expressions."""
    order: list[str] = []

    def need(body: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", body) and name not in order:
                need_once(name)

    def need_once(name: str) -> None:
        body = VIEWS[name]
        for other in VIEWS:
            if other != name and other not in order and re.search(rf"\b{other}\b", body):
                need_once(other)
        if name not in order:
            order.append(name)

    need(text)
    if text.lstrip().startswith("WITH"):
        text = f"SELECT * FROM ({text})"
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" if "RECURSIVE" not in VIEWS[n] else
                      f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{text}" if order else text


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def inn(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def pick(values, index: str) -> str:
    return f"list_extract({lst(values)}, CAST({index} AS BIGINT) + 1)"


def r9(expr: str) -> str:
    """Nine decimals, half up, for values that may be negative."""
    return f"floor(({expr}) * 1e9 + 0.5) / 1e9"


def rate(k: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 AND ({k}) <= ({n}) THEN CAST({k} AS DOUBLE) / ({n}) ELSE 0.0 END)"


def bound(k: str, n: str, sign: str) -> str:
    z, p, t = "1.959963984540054", f"(CAST({k} AS DOUBLE) / ({n}))", f"CAST(({n}) AS DOUBLE)"
    mid = f"({p} + {z}*{z}/(2.0*{t}))"
    root = f"{z} * sqrt(greatest(({p}*(1.0-{p}) + {z}*{z}/(4.0*{t})) / {t}, 0.0))"
    return (f"(CASE WHEN ({n}) > 0 AND ({k}) <= ({n}) THEN "
            f"least(1.0, greatest(0.0, ({mid} {sign} {root}) / (1.0 + {z}*{z}/{t}))) ELSE 0.0 END)")


def lower(k: str, n: str) -> str:
    return bound(k, n, "-")


def upper(k: str, n: str) -> str:
    return bound(k, n, "+")


def rates(specs: dict[str, tuple[str, str]]) -> str:
    out = []
    for name, (k, n) in specs.items():
        out += [f"{r9(rate(k, n))} AS {name}_rate", f"{r9(lower(k, n))} AS {name}_lower95",
                f"{r9(upper(k, n))} AS {name}_upper95"]
    return ", ".join(out)


def cnt(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


RISKY = inn(V.RISKY_ACTIONS)

# --- driver events -> requests ------------------------------------------------------
VIEWS["v_ev"] = """
SELECT event_id AS e, user_id AS u,
       1704067200000000 + (epoch_us(ts) - 1704067200000000) // 120 AS us
FROM events"""

VIEWS["v_req"] = f"""
SELECT e, u, us, 'session-' || lpad(CAST(u AS VARCHAR), CAST(greatest(8, length(CAST(u AS VARCHAR))) AS INTEGER), '0') AS sid, rn,
  {pick(V.REQUEST_ACTIONS, 'e % 13')} AS act, {pick(V.ENDPOINT_CLASSES, '(e*7+u) % 9')} AS ep,
  CASE WHEN u % 6 <> 5 THEN {pick(V.COHORTS, 'u % 6')} END AS cohort,
  greatest(1, rn + 30*(rn // 7) - CASE WHEN e % 11 = 0 THEN 3 ELSE 0 END) AS seq,
  e % 10 <> 0 AS ua, e % 6 AS bec, e % 2 = 0 AS bev,
  CASE WHEN e % 37 = 0 THEN 1 + e % 3 ELSE 0 END AS hp,
  CASE WHEN e % 31 = 0 THEN 'failed' ELSE 'unknown' END AS verdict,
  CASE WHEN e % 23 = 0 THEN (e % 100) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS risk,
  e % 29 = 0 AS alert, e % 13 = 0 AS bot,
  CASE WHEN e % 13 = 0 THEN {pick(V.CRAWLER_CLASSES[1:7], '(e//13) % 6')} ELSE 'unknown' END AS cclass,
  CASE WHEN e % 13 = 0 THEN {pick(V.CRAWLER_VERIFICATIONS[1:], '(e//13) % 3')} ELSE 'unknown' END AS cver,
  {pick(V.TRANSPORT_PROTOCOLS, '(e//3) % 4')} AS tproto,
  {pick(V.TRANSPORT_SECURITY, '(e//5) % 4')} AS tsec,
  {pick(V.ADDRESS_SOURCES, '(e//7) % 4')} AS tsrc,
  CASE WHEN e % 17 = 0 THEN {pick(V.FINGERPRINT_CLASSES[1:], '(e//17) % 3')} ELSE 'unknown' END AS fpc,
  CASE WHEN e % 17 = 0 THEN {pick(V.FINGERPRINT_METHODS[1:], '(e//51) % 3')} ELSE 'unknown' END AS fpm,
  CASE WHEN e % 19 < 4 THEN {pick(V.NETWORK_REPUTATIONS, 'e % 19 % 4')} ELSE 'unknown' END AS rep,
  CASE WHEN e % 21 < 7 THEN {pick(V.NETWORK_TYPES, 'e % 21 % 7')} ELSE 'unknown' END AS net,
  u % 3 = 0 AS sess,
  CASE WHEN e % 50 = 0 THEN 'observe' END AS want_action,
  CASE WHEN e % 100 = 0 THEN 'block' END AS want_computed
FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY us, e) AS rn FROM v_ev)"""


def features(source: str) -> str:
    """Session features of a source with sid, us, e, seq, ep."""
    return f"""
SELECT *, CAST(bit_count(mask) AS BIGINT) AS classes,
       CAST(sum(moved) OVER w AS BIGINT) AS transitions
FROM (
  SELECT *, CASE WHEN vis IS NOT NULL AND came IS NOT NULL AND vis <> came THEN 1 ELSE 0 END AS moved
  FROM (
    SELECT *, last_value(vis IGNORE NULLS) OVER wp AS came,
           bit_or(CASE WHEN vis IS NULL THEN 0
                  ELSE 1 << (list_position({lst(V.ENDPOINT_CLASSES)}, vis) - 1) END) OVER w AS mask,
           max(gap) OVER w AS max_gap
    FROM (
      SELECT *, CASE WHEN prev_seq IS NULL OR seq > prev_seq THEN ep END AS vis,
             CASE WHEN seq > prev_seq THEN seq - prev_seq - 1 ELSE 0 END AS gap
      FROM (
        SELECT *, row_number() OVER w AS n_req, min(us) OVER w AS first_us,
               max(seq) OVER wp AS prev_seq
        FROM (
          SELECT *, CAST(sum(fresh) OVER (PARTITION BY sid ORDER BY us, e) AS BIGINT) AS epoch
          FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY sid ORDER BY us, e) <= 300000000
                          THEN 0 ELSE 1 END AS fresh FROM {source}))
        WINDOW w AS (PARTITION BY sid, epoch ORDER BY us, e),
               wp AS (PARTITION BY sid, epoch ORDER BY us, e
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    WINDOW w AS (PARTITION BY sid, epoch ORDER BY us, e),
           wp AS (PARTITION BY sid, epoch ORDER BY us, e
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
WINDOW w AS (PARTITION BY sid, epoch ORDER BY us, e)"""


VIEWS["v_feat"] = features("v_req")

CRAWLER = (f"(bot AND ep IN {inn(V.PUBLIC_CRAWLER_ENDPOINTS)} AND cver IN "
           f"{inn(V.CRAWLER_VERIFICATIONS[1:])} AND cclass IN {inn(V.BENEFICIAL_CRAWLERS)})")

# (code, dimension, direction, strength, confidence, condition, detector)
SIGNALS = [
    ("UA_MISSING", "a", 1, "0.52", "0.72", "NOT ua", "protocol_consistency_v2"),
    ("BROWSER_PROTOCOL_CONTRADICTION", "a", 1, "0.82", "0.90", "bev AND bec > 0 AND NOT ua", "protocol_consistency_v2"),
    ("BROWSER_SEQUENCE_PRESENT", "c", -1, "0.24", "0.64", "bev AND bec >= 3 AND ua", "protocol_consistency_v2"),
    ("SERVER_SESSION_VERIFIED", "c", -1, "0.30", "0.95", "sess", "protocol_consistency_v2"),
    ("SESSION_VOLUME_HIGH", "i", 1, "0.54", "0.58", "n_req >= 100", "sequence_velocity_v2"),
    ("SESSION_BURST_FAST", "i", 1, "0.56", "0.60", "n_req >= 50 AND us - first_us BETWEEN 0 AND 60000000", "sequence_velocity_v2"),
    ("SEQUENCE_GAP_HIGH", "a", 1, "0.56", "0.70", "max_gap > 20", "sequence_velocity_v2"),
    ("SESSION_SEQUENCE_STABLE", "c", -1, "0.18", "0.60", "n_req > 1 AND max_gap <= 2", "sequence_velocity_v2"),
    ("NAVIGATION_SURFACE_SWEEP", "i", 1, "0.42", "0.45", "classes >= 5 AND transitions >= 6 AND us - first_us BETWEEN 0 AND 120000000", "navigation_graph_v1"),
    ("HONEYPOT_INTERACTION", "i", 1, "least(1.0, 0.62 + 0.12 * (hp - 1)::DOUBLE)", "0.88", "hp > 0", "decoy_interaction_v2"),
    ("DECOY_CAPABILITY_REDEEMED", "i", 1, "least(1.0, 0.72 + 0.12 * (vhits - 1)::DOUBLE)", "0.94", "vhits > 0", "decoy_interaction_v2"),
    ("COMPARE_NOINDEX_CAMPAIGN_SURFACE", "i", 1, "0.51", "0.75", "ep = 'compare_noindex'", "campaign_surface_v1"),
    ("CHALLENGE_VERDICT_SUSPICIOUS", "a", 1, "0.74", "0.78", "verdict IN ('suspicious','failed','blocked')", "external_verdicts_v3"),
    ("EXTERNAL_RISK", "i", 1, "least(1.0, risk)", "0.72", "risk > 0", "external_verdicts_v3"),
    ("POLICY_ALERT", "i", 1, "0.82", "0.86", "alert", "external_verdicts_v3"),
    ("VERIFIED_PUBLIC_CRAWLER", "a", -1, "0.68", "0.92", CRAWLER, "external_verdicts_v3"),
    ("EDGE_AUTOMATION_PROFILE", "a", 1, "0.58", "0.72", "fpc = 'automation_consistent'", "edge_intelligence_v1"),
    ("EDGE_PROTOCOL_ANOMALY", "a", 1, "0.48", "0.62", "fpc = 'anomalous'", "edge_intelligence_v1"),
    ("NETWORK_REPUTATION_ELEVATED", "i", 1, "0.46", "0.58", "rep = 'elevated_risk'", "edge_intelligence_v1"),
    ("NETWORK_REPUTATION_HIGH", "i", 1, "0.72", "0.76", "rep = 'high_risk'", "edge_intelligence_v1"),
    ("NETWORK_HOSTING_CONTEXT", "a", 1, "0.28", "0.40", "net = 'hosting'", "edge_intelligence_v1"),
    ("NETWORK_ANONYMIZER_CONTEXT", "a", 1, "0.32", "0.44", "net = 'anonymizer'", "edge_intelligence_v1"),
]


def scored(source: str, only: tuple[str, ...] | None = None) -> str:
    """Scores, evidence codes, crawler gate and policy of a feature source."""
    used = [s for s in SIGNALS if only is None or s[6] in only]

    def total(dim: str) -> str:
        terms = [f"CASE WHEN {w} THEN {d} * (({s})::DOUBLE * ({c})::DOUBLE * 2.0::DOUBLE) ELSE 0.0::DOUBLE END"
                 for _, dd, d, s, c, w, _ in used if dd == dim]
        return " + ".join(["0.0::DOUBLE", *terms])

    codes = ", ".join(f"CASE WHEN {w} THEN '{code}' END" for code, _, _, _, _, w, _ in used)
    over = lambda i, a: f"(intent >= {i} OR (NOT crawler AND auto >= {a}))"
    return f"""
SELECT *,
  CASE WHEN alert AND hits >= 1 THEN 'block'
       WHEN ep = 'public_content' AND {over('0.90', '0.88')} THEN 'throttle'
       WHEN {over('0.90', '0.88')} THEN 'block'
       WHEN alert OR hits >= 1 OR cont < 0.20 OR {over('0.68', '0.68')} THEN 'challenge'
       WHEN {over('0.52', '0.52')} THEN 'delay' ELSE 'allow' END AS computed,
  CASE WHEN alert AND hits >= 1 THEN 'MULTI_SOURCE_ABUSE'
       WHEN ep = 'public_content' AND {over('0.90', '0.88')} THEN 'PUBLIC_CONTENT_HIGH_RISK'
       WHEN {over('0.90', '0.88')} THEN 'HIGH_RISK'
       WHEN alert OR hits >= 1 OR cont < 0.20 OR {over('0.68', '0.68')} THEN 'STEP_UP_REQUIRED'
       WHEN {over('0.52', '0.52')} THEN 'ELEVATED_RISK'
       WHEN crawler AND NOT alert AND hits = 0 THEN 'VERIFIED_PUBLIC_CRAWLER_ALLOWED'
       ELSE 'BASELINE_LOW_RISK' END AS policy_reason
FROM (
  SELECT *, floor(1/(1+exp(-la)) * 10000 + 0.5) / 10000 AS auto,
         floor(1/(1+exp(-li)) * 10000 + 0.5) / 10000 AS intent,
         floor((1 - 1/(1+exp(-lc))) * 10000 + 0.5) / 10000 AS cont
  FROM (SELECT *, {total('a')} AS la, {total('i')} AS li, {total('c')} AS lc,
               list_filter([{codes}], lambda x: x IS NOT NULL) AS codes,
               {CRAWLER} AS crawler, least(100, hp + vhits) AS hits FROM {source}))"""


VIEWS["v_scored"] = scored("(SELECT *, 0 AS vhits FROM v_feat)")

VIEWS["v_shadow"] = f"""
SELECT *, CASE WHEN computed IN {RISKY} THEN 'observe' ELSE computed END AS action,
  list_concat(list_concat([policy_reason],
    CASE WHEN computed IN {RISKY} THEN ['SHADOW_ACTION_OVERRIDDEN'] ELSE [] END), codes) AS reasons
FROM v_scored"""

QUERIES["c_decisions_by_endpoint"] = """
SELECT ep AS endpoint_class, computed AS computed_action, CAST(count(*) AS BIGINT) AS decisions,
  CAST(max(n_req) AS BIGINT) AS max_requests
FROM v_shadow GROUP BY 1, 2"""
QUERIES["c1_session_epochs"] = """
SELECT sid AS session_id, epoch, CAST(count(*) AS BIGINT) AS requests, min(us) AS first_us, max(us) AS last_us
FROM v_feat GROUP BY 1, 2"""
QUERIES["c2_session_features"] = """
SELECT e AS line_no, epoch, CAST(n_req AS BIGINT) AS request_count, first_us AS first_seen_us,
  CAST(max_gap AS BIGINT) AS max_sequence_gap, classes AS distinct_endpoint_classes,
  transitions AS endpoint_transitions
FROM v_feat"""
QUERIES["c8_detector_signals"] = """
SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(codes) AS code FROM v_scored) GROUP BY 1"""
QUERIES["c9_detect"] = """
SELECT e AS line_no, list_aggregate(codes, 'string_agg', ',') AS codes
FROM v_scored"""
QUERIES["c11_fuse_scores"] = """
SELECT e AS line_no, auto AS automation_risk, intent AS abuse_intent_risk, cont AS account_continuity
FROM v_scored"""
QUERIES["c12_apply_policy"] = """
SELECT e AS line_no, computed AS computed_action, policy_reason FROM v_scored"""
QUERIES["c14_verified_crawler"] = """
SELECT cclass AS crawler_class, crawler AS qualified, CAST(count(*) AS BIGINT) AS n FROM v_scored
GROUP BY 1, 2"""
QUERIES["c15_shadow_mode"] = """
SELECT computed AS computed_action, action, CAST(count(*) AS BIGINT) AS n FROM v_shadow GROUP BY 1, 2"""
QUERIES["c16_assemble_decisions"] = """
SELECT e AS line_no, action, array_to_string(reasons, ',') AS reason_codes,
  us + 30000000 AS expires_us, 'pass' AS handling, us + 30000000 AS directive_expires_us
FROM v_shadow"""
QUERIES["c17_replay"] = """
SELECT e AS line_no, coalesce(want_action = action, true) AND coalesce(want_computed = computed, true) AS matched
FROM v_shadow"""
QUERIES["c17_first_mismatch"] = """
SELECT us AS observed_us, e AS line_no, want_action AS expected_action, action,
  want_computed AS expected_computed_action, computed AS computed_action
FROM v_shadow WHERE NOT (coalesce(want_action = action, true) AND coalesce(want_computed = computed, true))
ORDER BY us, e LIMIT 1"""

# --- decision log --------------------------------------------------------------------
VIEWS["v_dec"] = f"""
SELECT e, c AS copy, e*2 + c AS ord, 'd-' || CAST(e AS VARCHAR) AS did,
  us // 1000000 * 1000000 AS rec, sid, ep, {pick(V.COHORTS, 'u % 6')} AS cohort,
  CASE WHEN u % 4 = 0 THEN computed ELSE action END AS action, computed,
  CASE WHEN u % 4 = 0 THEN 'canary' ELSE 'shadow' END AS mode,
  CASE WHEN u % 8 = 0 THEN 'canary-a' WHEN u % 4 = 0 THEN 'canary-b' END AS rollout,
  auto, intent, cont, reasons,
  CASE WHEN e % 20 = 0 THEN 'default-v4' ELSE '{V.POLICY_VERSION}' END AS policy,
  '{V.MODEL_VERSION}' AS model,
  CASE WHEN e % 3 = 0 THEN NULL ELSE e % 3 - 1 END AS level, (e % 3 = 2 AND e % 5 = 0) AS withheld
FROM v_shadow, LATERAL (SELECT unnest(CASE WHEN e % 97 = 0 THEN [0, 1] ELSE [0] END) AS c)"""

_first = {o: next(t for t in V.OUTCOME_TRIPLES if t[0] == o) for o in V.OUTCOMES}


def _outcomes(cond: str, shift: int) -> str:
    k = f"((e//3) + {shift}) % 9"
    return f"""SELECT e,
  CASE WHEN e % 99 = 0 THEN NULL WHEN e % 60 = 0 THEN 'x-' || e::VARCHAR ELSE 'd-' || e::VARCHAR END AS did,
  rec + 600000000 AS rec, CASE WHEN e % 45 = 0 THEN {pick(V.ENDPOINT_CLASSES, '(e+1) % 9')} ELSE ep END AS ep,
  {pick(V.OUTCOMES, k)} AS outcome, {pick([_first[o][1] for o in V.OUTCOMES], k)} AS prov,
  {pick([_first[o][2] for o in V.OUTCOMES], k)} AS conf
FROM v_dec WHERE copy = 0 AND {cond}"""


VIEWS["v_out"] = _outcomes("e % 3 = 0", 0) + " UNION ALL " + _outcomes("e % 15 = 0", 1)


def hmac_static(key: bytes, message: str) -> str:
    from ..functions.expr import key_pads
    inner, outer = key_pads(key)
    return (f"unhex(sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || {message}))))")


def b64url(blob: str) -> str:
    return f"replace(replace(replace(base64({blob}), '+', '-'), '/', '_'), '=', '')"


def prefixed(text: str) -> str:
    return f"(unhex(printf('%016x', octet_length(encode({text})))) || encode({text}))"


def reason(*checks: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN '{r}'" for c, r in checks) + " END"


# --- A: contracts ---------------------------------------------------------------------
LOG_V = ("evidentry.log.v1", "evidentry.log.v2", "evidentry.log.v3", "evidentry.log.v4")

VIEWS["v_local"] = f"""
SELECT e, g, v, i, 1704067200000000 + (g % 100000)*7200000000 + off AS us,
  'seq-' || g::VARCHAR || '-' || CASE WHEN v = 1 AND i >= 40 THEN 'b' ELSE 'a' END AS subj,
  CASE WHEN g % 3 <> 0 THEN 's-seq-' || g::VARCHAR || '-' || CASE WHEN v = 1 AND i >= 40 THEN 'b' ELSE 'a' END END AS sess,
  {pick(V.LOCAL_SOURCES, 'e % 6')} AS source, {pick(V.LOCAL_ENDPOINTS, '(e//3) % 7')} AS ep,
  {pick(V.LOCAL_ACTIONS, 'e % 4')} AS act, {pick(V.STATUS_CLASSES, 'e % 5')} AS status,
  CASE WHEN e % 43 = 0 THEN 'missing' WHEN e % 31 = 0 THEN 'partial' ELSE 'complete' END AS coll,
  CASE WHEN e % 37 = 0 THEN (e//37) % 4 ELSE 0 END AS lv_auto,
  CASE WHEN e % 41 = 0 THEN (e//41) % 4 ELSE 0 END AS lv_intent,
  CASE WHEN e % 29 = 0 THEN (e//29) % 4 ELSE 0 END AS lv_cont,
  CASE WHEN e % 47 = 0 THEN (e//47) % 4 ELSE 0 END AS lv_decoy,
  CASE WHEN e % 23 = 0 THEN (e//23) % 6 ELSE 0 END AS ch,
  CASE WHEN e % 53 = 0 THEN 1 WHEN e % 59 = 0 THEN 2 WHEN e % 61 = 0 THEN 3 ELSE 0 END AS lab
FROM (SELECT *, CASE WHEN v = 0 THEN i*500000 WHEN v = 1 AND i < 40 THEN i*1000000
        WHEN v = 1 THEN (i-40)*20000000 WHEN v = 2 THEN i*301000000 WHEN v = 3 THEN i*30000000
        ELSE i*100000000 END AS off
      FROM (SELECT event_id AS e, event_id // 100 AS g, event_id % 100 AS i, (event_id // 100) % 5 AS v FROM events))"""

VIEWS["v_local_bad"] = """
SELECT *, CASE WHEN e % 101 = 0 THEN 'schema_version' WHEN e % 107 = 0 OR e % 109 = 0 THEN 'reference'
   WHEN e % 113 = 0 THEN 'closed_enum'
   WHEN e % 127 = 0 AND lab = 0 THEN 'label_pairing'
   WHEN e % 103 = 0 THEN 'observed_at' END AS why FROM v_local"""
QUERIES["a2_validate_evidence"] = """
SELECT coalesce(why, 'valid') AS reason, CAST(count(*) AS BIGINT) AS n FROM v_local_bad GROUP BY 1"""
QUERIES["a2_evidence_quarantine"] = "SELECT e AS line_no, why AS reason FROM v_local_bad WHERE why IS NOT NULL"
QUERIES["a3_check_chronology"] = """
SELECT e AS line_no, us AS observed_us, prev AS previous_us
FROM (SELECT e, us, lag(us) OVER (ORDER BY e) AS prev FROM v_local) WHERE us < prev"""
QUERIES["a6_source_summary"] = """
SELECT CAST(count(*) AS BIGINT) AS records, min(rec) AS first_us, max(rec) AS last_us,
  CAST(count(*) FILTER (WHERE k = 'd') AS BIGINT) AS decisions,
  CAST(count(*) FILTER (WHERE k = 'o') AS BIGINT) AS outcomes,
  CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS files
FROM (SELECT rec, 'd' AS k FROM v_dec UNION ALL SELECT rec, 'o' FROM v_out)"""
QUERIES["a7_scan_budget"] = """
SELECT 'records' AS "limit", CAST(count(*) AS BIGINT) AS observed, CAST(1000000 AS BIGINT) AS allowed,
  count(*) <= 1000000 AS ok FROM (SELECT e FROM v_dec UNION ALL SELECT e FROM v_out)"""

VIEWS["v_rough"] = """
SELECT e, """ + reason(
    ("e % 43 <> 0 AND e % 47 <> 0", "session_or_action"), ("e % 71 <> 0", "endpoint_or_sequence"),
    ("e % 53 <> 0 AND e % 59 <> 0", "count_bounds"), ("e % 61 <> 0", "risk_bounds"),
    ("e % 73 <> 0", "cohort"), ("NOT (bot AND e % 26 = 0)", "crawler_identity"),
    ("e % 67 <> 0", "transport"), ("NOT (fpc <> 'unknown' AND e % 34 = 0)", "edge_intelligence"),
) + " AS why FROM v_req"
QUERIES["a8_validate_decision_request"] = """
SELECT coalesce(why, 'valid') AS reason, CAST(count(*) AS BIGINT) AS n FROM v_rough GROUP BY 1"""

VIEWS["v_log"] = f"""
SELECT *, {reason(
    ("e % 73 <> 0", "session_key"), ("e % 59 <> 0", "shape"),
    ("(CASE WHEN e % 4 = 0 THEN e % 89 <> 0 ELSE true END) = (e % 4 <> 0 OR e % 89 <> 0)"
     " AND (e % 4 <> 0 OR e % 89 <> 0) AND (e % 4 >= 2 OR (action <> 'delay' AND computed <> 'delay'))"
     " AND e % 61 <> 0", "decision"),
    ("lvl IS NULL OR e % 4 = 3", "assurance_level"),
    ("NOT wh OR lvl IS NOT NULL", "assurance_withheld"),
    ("mode <> 'canary' OR e % 71 <> 0", "canary_rollout"),
    ("e % 67 <> 0", "reason_code"))} AS why
FROM (SELECT *, CASE WHEN e % 4 = 3 OR e % 83 = 0 THEN level END AS lvl,
             (withheld AND e % 4 = 3) OR e % 79 = 0 AS wh FROM v_dec)"""
VIEWS["v_logout"] = f"""
SELECT *, CASE WHEN did IS NULL OR (outcome, p2, conf) NOT IN (
    {', '.join(str(t) for t in V.OUTCOME_TRIPLES)}) THEN 'outcome' END AS why
FROM (SELECT *, CASE WHEN (rec // 60000000) % 60 % 7 = 0 THEN 'user_feedback' ELSE prov END AS p2 FROM v_out)"""
QUERIES["a9_decode_log_records"] = """
SELECT kind, reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'decision' AS kind, coalesce(why, 'valid') AS reason FROM v_log
  UNION ALL SELECT 'outcome', coalesce(why, 'valid') FROM v_logout) GROUP BY 1, 2"""
QUERIES["a9_split_log_records"] = """
SELECT part, reason, endpoint_class, CAST(count(*) AS BIGINT) AS n, min(rec) AS first_us, max(rec) AS last_us FROM (
  SELECT CASE WHEN why IS NULL THEN 'decision' ELSE 'quarantine-decision' END AS part, why AS reason,
    CASE WHEN why IS NULL THEN ep END AS endpoint_class, rec FROM v_log
  UNION ALL SELECT CASE WHEN why IS NULL THEN 'outcome' ELSE 'quarantine-outcome' END, why, CASE WHEN why IS NULL THEN ep END, rec FROM v_logout)
GROUP BY 1, 2, 3"""
QUERIES["a10_validate_outcomes"] = f"""
SELECT CASE WHEN did IS NULL THEN 'id_or_endpoint'
  WHEN (outcome, p2, conf) NOT IN ({', '.join(str(t) for t in V.OUTCOME_TRIPLES)}) THEN 'triple'
  ELSE 'valid' END AS reason, outcome, CAST(count(*) AS BIGINT) AS n FROM v_logout GROUP BY 1, 2"""
QUERIES["a11_normalise_log_row"] = """
SELECT e AS line_no, copy, CASE WHEN e % 31 = 0 THEN 'other' ELSE ep END AS endpoint_class,
  CASE WHEN e % 37 = 0 THEN 'unknown' ELSE did END AS decision_id,
  array_to_string(reasons, ',') AS reason_codes, rec AS recorded_us FROM v_dec"""
QUERIES["a12_session_key"] = f"""
SELECT DISTINCT sid AS session_id, {b64url(hmac_static(b'log-key-for-derived-tables', 'encode(sid)') + '[1:16]')} AS session_key
FROM v_req"""
QUERIES["a14_apply_retention"] = """
SELECT did AS decision_id, copy, rec AS recorded_us FROM v_dec WHERE rec >= (SELECT max(rec) FROM v_dec) - 86400000000"""
QUERIES["a14_retention_table"] = QUERIES["a14_apply_retention"]
QUERIES["a16_latest_valid_report"] = """
SELECT sid AS session_id, arg_max(e, struct_pack(us, e)) FILTER (WHERE e % 4 <> 0) AS report,
  max(us) FILTER (WHERE e % 4 <> 0) AS report_us, max(us) AS attempted_us,
  CASE WHEN max(us) FILTER (WHERE e % 4 <> 0) IS NULL THEN 'unavailable'
       WHEN arg_max(e % 4 <> 0, struct_pack(us, ok := e % 4 <> 0)) THEN 'ready' ELSE 'invalid_update' END AS state
FROM v_req GROUP BY 1"""

# --- B: pseudonyms ----------------------------------------------------------------------


def _pseudonyms() -> None:
    from ..operators.pseudonym import DAY_LABEL, domain_key
    domain = domain_key(b"k" * 32, "dataset-a", "pilot-a")
    day_key = hmac_static(domain, f"{prefixed(repr(DAY_LABEL))} || {prefixed('day')}")

    def pad(byte: int) -> str:
        return (f"CAST(xor(CAST(k || unhex('{'00' * 32}') AS BIT), CAST(unhex('{f'{byte:02x}' * 64}') AS BIT)) AS BLOB)")

    VIEWS["v_days"] = f"""
SELECT day, {pad(0x36)} AS ip, {pad(0x5c)} AS op FROM (
  SELECT day, {day_key} AS k FROM (
    SELECT DISTINCT strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM v_local))"""

    def pseudonym(kind: str, *refs: str) -> str:
        msg = " || ".join([prefixed(f"'{kind}'"), *[prefixed(r) for r in refs]])
        return b64url(f"unhex(sha256(op || unhex(sha256(ip || {msg}))))")

    VIEWS["v_pseudo"] = f"""
SELECT v_local.*, {pseudonym('subject', 'subj')} AS subject_id,
  CASE WHEN sess IS NOT NULL THEN {pseudonym('session', 'subj', 'sess')} END AS session_id
FROM v_local JOIN v_days ON strftime(make_timestamp(us), '%Y-%m-%d') = day"""
    QUERIES["b2_pseudonymise"] = "SELECT e AS line_no, subject_id, session_id FROM v_pseudo"


_pseudonyms()

# --- C/D: enforcement with a plan, folded row by row ----------------------------------------
PLAN_END = 1704067200000000 + 5 * 3600 * 1000000
CONF = ", ".join(f"CASE WHEN ({w}) AND ({s}) >= 0.5 THEN {c} ELSE 0.0 END"
                 for _, _, d, s, c, w, _ in SIGNALS if d == 1)
RANK = f"(list_position({lst(V.ACTIONS)}, computed) - 1)"
VIEWS["v_plan"] = f"""
SELECT *, row_number() OVER (PARTITION BY sid ORDER BY us, e) AS k,
  CASE WHEN ep NOT IN {inn(V.ROLLOUT_ENDPOINTS)} OR us >= {PLAN_END}
       THEN CASE WHEN computed IN {RISKY} THEN 'observe' ELSE computed END ELSE computed END AS act2,
  CASE WHEN us >= {PLAN_END} THEN 'ROLLOUT_EXPIRED'
       WHEN ep NOT IN {inn(V.ROLLOUT_ENDPOINTS)} THEN 'ROLLOUT_ENDPOINT_EXCLUDED' END AS excl,
  greatest({CONF}) AS conf
FROM v_scored"""
_base = "CASE p.act2 WHEN 'delay' THEN 1 WHEN 'throttle' THEN 30 WHEN 'block' THEN 600 ELSE 0 END"
_ttl = "CASE p.act2 WHEN 'delay' THEN 1 WHEN 'throttle' THEN 30 WHEN 'block' THEN 600 WHEN 'challenge' THEN 300 ELSE 30 END"
_left = f"greatest(({PLAN_END} - p.us) // 1000000, 1)"
_clip = lambda secs, exp: f"CASE WHEN {secs} > 0 AND {PLAN_END} < {exp} THEN least({secs}, {_left}) ELSE {secs} END"
def _fold_body() -> str:
    scaled = lambda low: (f"CASE WHEN r0 <= {low} OR tier <= 0 THEN {low} WHEN tier >= 4 THEN r0 "  # noqa: E731
                          f"ELSE {low} + ((r0-{low})*tier + 3)//4 END")
    return f"""
WITH RECURSIVE prep AS MATERIALIZED (
  SELECT p.*, {_clip('(' + _base + ')', f'p.us + ({_ttl})*1000000')} AS r0,
    (p.ep IN ('compare_index','compare_noindex'))::INT + (p.conf >= 0.75)::INT
      + (p.n_req >= 50 OR p.transitions >= 6)::INT AS t0, p.act2 IN {RISKY} AS enf
  FROM v_plan p),
fold AS (
  SELECT sid, 0::BIGINT AS k, -1::BIGINT AS e, 0::BIGINT AS epoch, 0::BIGINT AS recent_after,
    0::BIGINT AS recent, 0::BIGINT AS prem, 0::BIGINT AS until, 0::BIGINT AS tier, 0::BIGINT AS sec
  FROM prep WHERE k = 1
  UNION ALL
  SELECT sid, k, e, epoch, recent + enf::INT, recent, prem,
    greatest(until, CASE WHEN sec > 0 THEN least(us + sec*1000000, {PLAN_END}) ELSE 0 END), tier, sec
  FROM (
    SELECT *, CASE WHEN act2 IN ('throttle','block') AND {PLAN_END} < us + sec1*1000000
                   THEN least(sec1, greatest(({PLAN_END} - us)//1000000, 1)) ELSE sec1 END AS sec
    FROM (
      SELECT *, CASE act2 WHEN 'throttle' THEN {scaled(1)} WHEN 'block' THEN {scaled(60)} ELSE r0 END AS sec1
      FROM (
        SELECT *, (t0 + (recent >= 2 OR prem >= 1)::INT)::BIGINT AS tier
        FROM (
          SELECT p.*, CASE WHEN p.epoch = f.epoch THEN f.until ELSE 0 END AS until,
            CASE WHEN p.epoch = f.epoch THEN f.recent_after ELSE 0 END AS recent,
            CASE WHEN p.epoch = f.epoch THEN f.prem + (f.until > p.us)::INT ELSE 0 END AS prem
          FROM fold f JOIN prep p ON p.sid = f.sid AND p.k = f.k + 1)))))
SELECT p.*, f.recent, f.prem, f.tier, f.sec FROM fold f JOIN prep p ON p.sid = f.sid AND p.k = f.k"""


VIEWS["v_fold"] = _fold_body()
QUERIES["c3_enforcement_history"] = """
SELECT e AS line_no, least(recent, 255) AS recent_enforcements, least(prem, 255) AS premature_retries FROM v_fold"""
QUERIES["d3_response_cost"] = """
SELECT e AS line_no, CASE WHEN act2 IN ('throttle','block') THEN tier END AS tier,
  CAST(sec AS BIGINT) AS retry_after_seconds FROM v_fold"""
QUERIES["d2_enforced_decisions"] = f"""
SELECT e AS line_no, act2 AS action, CASE WHEN excl IS NULL THEN 'enforce' ELSE 'shadow' END AS mode,
  array_to_string(list_concat(list_filter([policy_reason, excl,
    CASE WHEN act2 IN ('throttle','block') AND ep IN ('compare_index','compare_noindex') THEN 'RESPONSE_COST_ENDPOINT_VALUE' END,
    CASE WHEN act2 IN ('throttle','block') AND conf >= 0.75 THEN 'RESPONSE_COST_CONFIDENT_EVIDENCE' END,
    CASE WHEN act2 IN ('throttle','block') AND (n_req >= 50 OR transitions >= 6) THEN 'RESPONSE_COST_RECENT_BEHAVIOR' END,
    CASE WHEN act2 IN ('throttle','block') AND (recent >= 2 OR prem >= 1) THEN 'RESPONSE_COST_RETRY_HISTORY' END,
    CASE WHEN act2 IN ('throttle','block') AND tier = 0 THEN 'RESPONSE_COST_BASELINE' END,
    CASE WHEN excl IS NOT NULL AND computed IN {RISKY} THEN 'SHADOW_ACTION_OVERRIDDEN' END],
    lambda x: x IS NOT NULL), codes), ',') AS reason_codes
FROM v_fold"""
QUERIES["d1_canary_bucket"] = f"""
SELECT DISTINCT sid AS session_id, CAST(('0x' || substr(hex({hmac_static(b'log-key-for-derived-tables',
    "encode('evidentry:rollout-cohort:v1') || unhex('00') || encode('canary-a') || unhex('00') || encode(sid)")}), 1, 4)) AS BIGINT) % 10000 AS bucket
FROM v_req"""
VIEWS["v_bucket"] = QUERIES["d1_canary_bucket"]
QUERIES["d2_apply_rollout"] = f"""
SELECT e AS line_no, CASE WHEN excl IS NOT NULL AND computed IN {RISKY} THEN 'observe' WHEN excl IS NOT NULL THEN computed
    WHEN computed IN ('challenge','block') THEN 'throttle' ELSE computed END AS action,
  CASE WHEN excl IS NOT NULL THEN 'shadow' ELSE 'canary' END AS mode,
  coalesce(excl, CASE WHEN computed IN ('challenge','block') THEN 'ROLLOUT_ACTION_CAPPED' ELSE '' END) AS reasons
FROM (SELECT *, CASE WHEN us >= {PLAN_END} THEN 'ROLLOUT_EXPIRED'
        WHEN ep NOT IN ('compare_index','public_content') THEN 'ROLLOUT_ENDPOINT_EXCLUDED'
        WHEN bucket >= 1000 THEN 'ROLLOUT_CANARY_EXCLUDED' END AS excl
      FROM v_scored JOIN v_bucket ON sid = session_id)"""
_cttl = "CASE computed WHEN 'delay' THEN 1 WHEN 'throttle' THEN 30 WHEN 'block' THEN 600 WHEN 'challenge' THEN 300 ELSE 30 END"
_cbase = "CASE computed WHEN 'delay' THEN 1 WHEN 'throttle' THEN 30 WHEN 'block' THEN 600 ELSE 0 END"
QUERIES["d4_directive"] = f"""
SELECT e AS line_no, CASE WHEN computed IN {RISKY} THEN computed ELSE 'pass' END AS handling,
  CAST(CASE computed WHEN 'delay' THEN 429 WHEN 'throttle' THEN 429 WHEN 'challenge' THEN 403 WHEN 'block' THEN 403 ELSE 200 END AS BIGINT) AS http_status,
  CAST(CASE WHEN {PLAN_END} < us + ttl*1000000 AND r0 > 0 THEN least(r0, greatest(floor(({PLAN_END} - us)/1e6), 1)) ELSE r0 END AS BIGINT) AS retry_after_seconds,
  least(us + ttl*1000000, {PLAN_END}) AS expires_us
FROM (SELECT *, {_cttl} AS ttl, {_cbase} AS r0 FROM v_scored)"""

# --- C4..C7 ---------------------------------------------------------------------------------
VIEWS["v_batch"] = """
SELECT *, CAST(sum(fresh) OVER (PARTITION BY sid ORDER BY us, e) AS BIGINT) AS epoch FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY sid ORDER BY us, e) <= 300000000 THEN 0 ELSE 1 END AS fresh
  FROM (SELECT e, u, us, sid, greatest(1, 2*rn - e % 3) AS s0, e % 5 AS len FROM v_req WHERE e % 41 <> 0))"""
VIEWS["v_receipt"] = """
SELECT e, u, us, sid, acc, CAST(sum(acc) OVER w AS BIGINT) AS total, row_number() OVER w AS bseq FROM (
  SELECT *, CASE WHEN seen IS NULL THEN len + 1 ELSE greatest(0, s0 + len - greatest(seen, s0 - 1)) END AS acc FROM (
    SELECT *, max(s0 + len) OVER (PARTITION BY sid, epoch ORDER BY us, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM v_batch))
WINDOW w AS (PARTITION BY sid, epoch ORDER BY us, e)"""
QUERIES["c4_ingest_event_batches"] = """
SELECT e AS line_no, CAST(acc AS BIGINT) AS accepted_events, total AS total_accepted_events, bseq AS batch_sequence FROM v_receipt"""
QUERIES["c5_verified_event_count"] = """
SELECT r.sid AS session_id, r.e AS line_no,
  CASE WHEN c.us IS NULL OR r.us - c.us > 300000000 THEN 0 ELSE c.total END AS verified_event_count
FROM v_req r ASOF LEFT JOIN v_receipt c ON r.sid = c.sid AND r.us >= c.us"""
VIEWS["v_hit"] = f"""
SELECT e, 'cap-' || e::VARCHAR AS cap, us AS iss, us + 600000000 AS exp, sid, ep, e % 2 = 0 AS form,
  us + (e % 13 * 60 + j*45 - CASE WHEN e % 35 = 0 THEN 60 ELSE 0 END)*1000000 AS hat, e*3 + j AS line,
  {pick(('rendered', 'touched', 'submitted', 'gazed'), '(e + j) % 4')} AS inter
FROM (SELECT *, unnest(range(0, e % 3 + 1)) AS j FROM v_req WHERE e % 5 = 0)"""
VIEWS["v_redeem"] = """
SELECT * FROM v_hit WHERE inter IN ('touched', 'submitted') AND (form OR inter <> 'submitted') AND hat >= iss AND hat < exp
QUALIFY row_number() OVER (PARTITION BY cap ORDER BY hat, line) = 1"""
QUERIES["c6_redeem_decoys"] = """
SELECT cap AS capability, hat AS hit_us, line AS hit_line_no, inter AS interaction FROM v_redeem"""
VIEWS["v_pending"] = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY sid, ep ORDER BY us, side, line) AS k FROM (
    SELECT sid, ep, us, 1 AS side, e AS line FROM v_req
    UNION ALL SELECT sid, ep, hat, 0, line FROM v_redeem)),
f AS (
  SELECT sid, ep, 0::BIGINT AS k, 1 AS side, 0::BIGINT AS line, 0::BIGINT AS hits, 0::BIGINT AS exp, 0::BIGINT AS taken
  FROM t WHERE k = 1
  UNION ALL
  SELECT t.sid, t.ep, t.k, t.side, t.line,
    CASE WHEN t.side = 1 THEN 0 WHEN f.exp > t.us THEN least(f.hits + 1, 100) ELSE 1 END,
    CASE WHEN t.side = 1 THEN 0 ELSE t.us + 300000000 END,
    CASE WHEN t.side = 1 AND f.exp > t.us THEN f.hits ELSE 0 END
  FROM f JOIN t ON t.sid = f.sid AND t.ep = f.ep AND t.k = f.k + 1)
SELECT sid, line AS e, taken FROM f WHERE side = 1 AND k > 0"""
QUERIES["c7_attach_decoy_hits"] = """
SELECT sid AS session_id, e AS line_no, taken AS verified_decoy_hits FROM v_pending"""
VIEWS["v_busy"] = features("""(SELECT * REPLACE (
  'session-' || lpad(CAST(e // 200 AS VARCHAR), CAST(greatest(8, length(CAST(e // 200 AS VARCHAR))) AS INTEGER), '0') AS sid,
  1704067200000000 + e // 200 % 1000000 * 600000000 + e % 200 * 250000 AS us, e % 200 + 1 AS seq) FROM v_req)""")
VIEWS["v_busy_scored"] = scored("(SELECT *, 0 AS vhits FROM v_busy)")
VIEWS["v_decoy_scored"] = scored("(SELECT v_feat.*, p.taken AS vhits FROM v_feat JOIN v_pending p USING (sid, e))")
for _name, _view in (("c8_burst_signals", "v_busy_scored"), ("c8_decoy_signals", "v_decoy_scored")):
    QUERIES[_name] = f"SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(codes) AS code FROM {_view}) GROUP BY 1"
QUERIES["c8_user_detector"] = """
SELECT unnest(['COMPARE_NOINDEX_CAMPAIGN_SURFACE', 'OTHER_SURFACE_REPEATED']) AS code,
  unnest([CAST(count(*) FILTER (WHERE ep = 'compare_noindex') AS BIGINT),
          CAST(count(*) FILTER (WHERE ep = 'other' AND n_req > 1) AS BIGINT)]) AS n FROM v_feat"""
VIEWS["v_subset"] = scored("(SELECT *, 0 AS vhits FROM v_feat)", ("decoy_interaction_v2", "protocol_consistency_v2"))
QUERIES["c9_detect_subset"] = """
SELECT computed AS computed_action, policy_reason, CAST(count(*) AS BIGINT) AS n FROM v_subset GROUP BY 1, 2"""
QUERIES["c10_validate_evidence_rows"] = """
SELECT e AS line_no, len(codes) = 0 OR (e % 31 <> 0 AND e % 37 <> 0) AS evidence_valid FROM v_scored"""

# --- C18..C20 -------------------------------------------------------------------------------
VIEWS["v_shadow_feat"] = features("""(
  SELECT sid, us, e, u, bseq AS seq, 'public_content' AS ep, e % 10 <> 0 AS ua, total AS bec, true AS bev, 0 AS hp,
    0 AS vhits, 'unknown' AS verdict, 0.0::DOUBLE AS risk, false AS alert, false AS bot, 'unknown' AS cclass, 'unknown' AS cver,
    'unknown' AS fpc, 'unknown' AS rep, 'unknown' AS net, u % 3 = 0 AS sess FROM v_receipt)""")
VIEWS["v_shadow_scored"] = scored("v_shadow_feat")
QUERIES["c18_event_shadow_decisions"] = f"""
SELECT e AS line_no, CASE WHEN computed = 'allow' THEN 'allow' ELSE 'observe' END AS action, computed AS computed_action,
  array_to_string(list_concat(list_concat([policy_reason],
    CASE WHEN computed IN {RISKY} THEN ['SHADOW_ACTION_OVERRIDDEN'] ELSE [] END), codes), ',') AS reason_codes
FROM v_shadow_scored"""
_contra = " OR ".join(f"list_contains(codes, '{c}')" for c, dim, d, _, conf, _, _ in SIGNALS
                      if dim == "a" and d == 1 and float(conf) >= 0.6)
QUERIES["c19_derive_assurance"] = f"""
SELECT e AS line_no, CAST(least(earned, 1) AS BIGINT) AS assurance_level,
  CASE WHEN earned >= 1 THEN 'behavioral' ELSE '' END AS sources,
  array_to_string(list_filter([
    CASE WHEN con THEN 'automation_evidence_contradicts_presence' END,
    CASE WHEN earned = 2 THEN 'interactive_liveness_completed' END,
    CASE WHEN earned = 2 THEN 'level_withheld_pending_measurement' END,
    CASE WHEN NOT con AND NOT seq_ok THEN 'no_verified_interaction_evidence' END,
    CASE WHEN list_contains(codes, 'SERVER_SESSION_VERIFIED') THEN 'server_session_verified' END,
    CASE WHEN NOT con AND seq_ok THEN 'verified_browser_sequence' END], lambda x: x IS NOT NULL), ',') AS reasons,
  earned = 2 AS assurance_withheld
FROM (SELECT *, CASE WHEN con OR NOT seq_ok THEN 0 WHEN e % 3 = 0 THEN 2 ELSE 1 END AS earned
  FROM (SELECT *, ({_contra}) AS con, list_contains(codes, 'BROWSER_SEQUENCE_PRESENT') AS seq_ok FROM v_scored))"""
QUERIES["c20_agent_provenance"] = f"""
SELECT CASE WHEN NOT bot THEN 'none' WHEN {CRAWLER} THEN 'verified_purpose' ELSE 'declared' END AS provenance,
  CASE WHEN bot THEN cclass ELSE '' END AS purpose,
  CASE WHEN NOT bot THEN '' WHEN {CRAWLER} THEN 'agent_verified_for_declared_purpose'
    WHEN cclass IN {inn(V.BENEFICIAL_CRAWLERS)} AND ep NOT IN {inn(V.PUBLIC_CRAWLER_ENDPOINTS)}
    THEN 'agent_identity_declared_not_verified,agent_purpose_not_permitted_on_endpoint'
    ELSE 'agent_identity_declared_not_verified' END AS reasons, CAST(count(*) AS BIGINT) AS n
FROM v_req GROUP BY 1, 2, 3"""

# --- C21..C28 -------------------------------------------------------------------------------
VIEWS["v_ua"] = """
SELECT e, e % 5 AS agent, CASE e % 4 WHEN 0 THEN 66*256+249 WHEN 1 THEN 66*256+250 WHEN 2 THEN 2560 ELSE 203*256 END AS hi,
  e % 3 AS b3, e % 251 AS b4, e % 97 = 0 AS bad, e % 97 <> 0 AND e % 6 = 5 AS six FROM v_ev"""
QUERIES["c21_verify_crawlers"] = """
SELECT e AS line_no, n = 1 AS verified_bot,
  CASE WHEN n <> 1 THEN 'unknown' WHEN s THEN 'search_indexer' ELSE 'preview' END AS crawler_class,
  CASE WHEN n = 1 THEN 'ip_ua_registry' ELSE 'unknown' END AS crawler_verification
FROM (SELECT *, s::INT + p::INT + q::INT AS n FROM (
  SELECT e, NOT bad AND agent IN (0, 3) AND ((NOT six AND hi = 66*256+249) OR (six AND e % 5 = 1)) AS s,
    NOT bad AND NOT six AND agent = 3 AND ((hi = 66*256+249 AND b3 = 0) OR (hi = 66*256+250 AND b3 = 1)) AS p,
    NOT bad AND NOT six AND agent IN (2, 3) AND hi = 66*256+250 AS q FROM v_ua))"""
QUERIES["c22_normalise_transport"] = """
SELECT e AS line_no, CASE WHEN e % 5 IN (1,2,3) THEN 'http' || (e % 5)::VARCHAR ELSE 'unknown' END AS transport_protocol,
  CASE WHEN t THEN CASE e % 5 WHEN 0 THEN 'trusted_proxy_tls' WHEN 1 THEN 'plaintext' ELSE 'unknown' END
       WHEN e % 3 = 0 THEN 'direct_tls' ELSE 'plaintext' END AS transport_security,
  CASE WHEN e % 11 = 0 THEN 'unknown' WHEN NOT t THEN 'direct' WHEN e % 8 >= 4 THEN 'trusted_proxy' ELSE 'invalid_trusted_proxy' END AS client_address_source
FROM (SELECT *, e % 11 <> 0 AND (hi = 66*256+249 OR (hi = 66*256+250 AND b3 = 2)) AS t FROM v_ua)"""


def _merge(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 'unknown' AND NOT clash THEN {b} ELSE {a} END"


QUERIES["c23_merge_signals"] = f"""
SELECT e AS line_no, clash AS signal_conflict, {_merge('verdict', 'v2')} AS challenge_verdict,
  {_merge('fpc', 'f2')} AS edge_fingerprint_class, {_merge('fpm', 'm2')} AS edge_fingerprint_method,
  {_merge('rep', 'r2')} AS network_reputation, {_merge('net', 'n2')} AS network_type,
  CASE WHEN clash THEN risk ELSE greatest(risk, CASE WHEN e % 4 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) END AS external_risk_score,
  CASE WHEN clash THEN alert ELSE alert OR e % 33 = 0 END AS policy_alert
FROM (SELECT *, (verdict <> 'unknown' AND v2 <> 'unknown' AND verdict <> v2) OR (fpc <> 'unknown' AND f2 <> 'unknown' AND fpc <> f2)
    OR (fpm <> 'unknown' AND m2 <> 'unknown' AND fpm <> m2) OR (rep <> 'unknown' AND r2 <> 'unknown' AND rep <> r2)
    OR (net <> 'unknown' AND n2 <> 'unknown' AND net <> n2) AS clash
  FROM (SELECT *, CASE WHEN e % 3 = 0 THEN 'passed' ELSE 'unknown' END AS v2, CASE WHEN e % 5 = 0 THEN 'anomalous' ELSE 'unknown' END AS f2,
    CASE WHEN e % 5 = 0 THEN 'tls' ELSE 'unknown' END AS m2, CASE WHEN e % 7 = 0 THEN 'high_risk' ELSE 'unknown' END AS r2,
    CASE WHEN e % 11 = 0 THEN 'hosting' ELSE 'unknown' END AS n2 FROM v_req))"""
QUERIES["c6_issue_decoys"] = f"""
SELECT e AS capability, CASE WHEN e % 43 = 0 OR length('session-' || u::VARCHAR) < 8 THEN 'session_id' WHEN e % 47 = 0 THEN 'endpoint_class'
  WHEN e % 53 = 0 OR e % 97 = 0 THEN 'surface' WHEN e % 59 = 0 OR e % 61 = 0 THEN 'lifetime' END AS reason FROM v_ev"""
# Two uses have a nonce; the second is free where the first took nothing or is past.
QUERIES["c23_edge_envelopes"] = """
WITH x AS (SELECT e, us AS used, us - (e % 7) * 1000000 + CASE WHEN e % 41 = 0 THEN 60000000 WHEN e % 31 = 0 THEN -600000000 ELSE 0 END AS issued FROM v_ev),
f AS (SELECT *, CASE WHEN e % 17 = 0 THEN 'bad_signature'
  WHEN e % 29 = 0 OR e % 37 = 0 OR NOT (e % 3 = 0 OR e % 5 = 0 OR e % 7 = 0 OR e % 11 = 0 OR e % 4 = 0) THEN 'malformed'
  WHEN used - issued NOT BETWEEN -5000000 AND 30000000 THEN 'expired' END AS fault FROM x),
g AS (SELECT *, row_number() OVER w AS k, lag(issued) OVER w AS p FROM f WHERE fault IS NULL WINDOW w AS (PARTITION BY e // 2 ORDER BY used, e))
SELECT e AS line_no, fault AS use FROM f WHERE fault IS NOT NULL
UNION ALL SELECT e, CASE WHEN k = 1 OR p + 35000000 <= used THEN 'accepted' ELSE 'replayed' END FROM g"""
QUERIES["c24_audit_single_use"] = """
SELECT e AS line_no, CASE WHEN bad IS NOT NULL THEN bad
    WHEN coalesce(lag(exp) OVER (PARTITION BY e // 2, bad IS NULL ORDER BY us, e), 0) <= us THEN 'accepted' ELSE 'replayed' END AS use
FROM (SELECT e, us, iss + CASE WHEN e % 19 = 0 THEN 1000000 ELSE 60000000 END AS exp, CASE WHEN e % 17 = 0 THEN 'bad_signature' WHEN e % 23 = 0 THEN 'malformed'
        WHEN iss > us + 30000000 OR iss + CASE WHEN e % 19 = 0 THEN 1000000 ELSE 60000000 END <= us THEN 'expired' END AS bad
      FROM (SELECT *, us - (e % 7)*1000000 + CASE WHEN e % 41 = 0 THEN 40000000 ELSE 0 END AS iss FROM v_ev))"""
VIEWS["v_rev"] = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT u % 7 AS doc, e, e // 20 + e * 13 % 50 AS r, e % 3 AS d, e % 19 <> 0 AS ok,
    row_number() OVER (PARTITION BY u % 7 ORDER BY us, e) AS k FROM v_ev),
f AS (
  SELECT DISTINCT doc, 0::BIGINT AS k, -1::BIGINT AS e, NULL::BIGINT AS r, NULL::BIGINT AS d, '' AS up FROM t
  UNION ALL
  SELECT t.doc, t.k, t.e, CASE WHEN t.ok AND (f.r IS NULL OR t.r > f.r) THEN t.r ELSE f.r END,
    CASE WHEN t.ok AND (f.r IS NULL OR t.r > f.r) THEN t.d ELSE f.d END,
    CASE WHEN NOT t.ok THEN 'invalid' WHEN f.r IS NULL OR t.r > f.r THEN 'installed'
         WHEN t.r = f.r AND t.d = f.d THEN 'unchanged' ELSE 'rollback' END
  FROM f JOIN t ON t.doc = f.doc AND t.k = f.k + 1)
SELECT * FROM f WHERE k > 0"""
QUERIES["c25_monotone_revisions"] = """
SELECT doc AS document, e AS line_no, up AS "update", r AS installed_revision FROM v_rev"""
QUERIES["c26_issuer_trust"] = """
WITH lists AS (SELECT e // 500 + 1 AS rev, us AS inst, us + CASE WHEN (e//500) % 2 = 0 THEN 600000000 ELSE 86400000000 END AS exp
               FROM v_ev WHERE e % 500 = 3)
SELECT c.e AS line_no, ok AS trusted, CAST(CASE WHEN ok THEN least(c.u % 5 % 3, 1) ELSE 0 END AS BIGINT) AS maximum_assurance_level,
  CASE WHEN ok THEN 'per_service' END AS uniqueness_scope
FROM (SELECT x.*, coalesce(l.rev IS NOT NULL AND x.us < l.exp AND x.u % 5 < 4 AND x.e % 97 <> l.rev * 7 % 97, false) AS ok
      FROM v_ev x ASOF LEFT JOIN lists l ON x.us >= l.inst) c"""
VIEWS["v_chal"] = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY e ORDER BY us, j) AS k FROM (
    SELECT e, j, us0, us0 + (j*(1 + e % 50) + e % 4)*1000000 AS us,
      CASE WHEN (e+j) % 11 = 10 THEN 'fallback' WHEN (e+j) % 3 = 2 THEN 'redeem' ELSE 'verify' END AS kind, (e+j) % 5 = 0 AS ok
    FROM (SELECT e, us AS us0, unnest(range(0, e % 9 + 1)) AS j FROM v_ev WHERE e % 7 = 0))),
f AS (
  SELECT e, 0::BIGINT AS k, 'issued' AS state, 0 AS tries, 0::BIGINT AS rexp, NULL::VARCHAR AS outcome FROM t WHERE k = 1
  UNION ALL
  SELECT e, k, CASE WHEN nxt IS NOT NULL THEN 'done' WHEN verified THEN 'verified' ELSE state END,
    tries + wrong::INT, CASE WHEN verified THEN least(us + 60000000, us0 + 300000000) ELSE rexp END, coalesce(outcome, nxt)
  FROM (
    SELECT *, CASE WHEN state = 'done' THEN NULL WHEN us >= us0 + 300000000 THEN 'challenge_abandoned'
        WHEN wrong AND tries + 1 >= 5 THEN 'challenge_failed'
        WHEN kind = 'redeem' AND state = 'verified' AND us >= rexp THEN 'challenge_abandoned'
        WHEN kind = 'redeem' AND state = 'verified' AND ok THEN 'challenge_passed'
        WHEN kind = 'fallback' THEN 'fallback_used' END AS nxt
    FROM (SELECT t.*, f.state, f.tries, f.rexp, f.outcome,
            f.state = 'issued' AND t.kind = 'verify' AND NOT t.ok AND t.us >= t.us0 + 2000000 AND t.us < t.us0 + 300000000 AS wrong,
            f.state = 'issued' AND t.kind = 'verify' AND t.ok AND t.us >= t.us0 + 2000000 AND t.us < t.us0 + 300000000 AS verified
          FROM f JOIN t ON t.e = f.e AND t.k = f.k + 1)))
SELECT e, coalesce(arg_max(outcome, k), 'challenge_abandoned') AS outcome FROM f GROUP BY e"""
QUERIES["c27_challenge_lifecycle"] = "SELECT 'ch-' || e::VARCHAR AS challenge_id, outcome FROM v_chal"
QUERIES["c28_liveness_attempts"] = """
WITH a AS (
  SELECT *, row_number() OVER (PARTITION BY e ORDER BY ta, j) - 1 AS p FROM (
    SELECT e, j, us, us + j*5000000 AS rev, us + j*5000000 + CASE WHEN e % 44 = 0 THEN 100000 WHEN e % 52 = 0 THEN 4900000
        WHEN e % 68 = 0 THEN 70000000 ELSE 500000 END AS ta,
      j + CASE WHEN e % 28 = 0 AND j > 0 THEN 1 ELSE 0 END AS rnd
    FROM (SELECT e, us, unnest(range(0, e % 5 + 1)) AS j FROM v_ev WHERE e % 4 = 0))),
b AS (SELECT *, CASE WHEN ta >= us + 60000000 THEN 'expired' WHEN rnd <> p THEN 'out_of_order' WHEN ta < rev + 120000 THEN 'too_fast'
        WHEN ta >= rev + 4000000 THEN 'expired' WHEN (e+j) % 13 = 0 THEN 'wrong_answer' END AS bad FROM a WHERE p < 3)
SELECT 'at-' || e::VARCHAR AS attempt_id, CASE WHEN count(bad) > 0 THEN 'failed' WHEN count(*) >= 3 THEN 'completed' ELSE 'open' END AS state,
  arg_min(bad, p) FILTER (WHERE bad IS NOT NULL) AS failure FROM b GROUP BY e"""

# --- E: windows ----------------------------------------------------------------------------
VIEWS["v_seq"] = """
SELECT *, CASE WHEN sess IS NOT NULL THEN 'session:' || sess ELSE 'subject:' || subj END AS key,
  row_number() OVER (PARTITION BY coalesce(sess, subj) ORDER BY us, e) AS k FROM v_local"""
VIEWS["v_win_ev"] = """
WITH RECURSIVE f AS (
  SELECT key, k, e, us, us AS w FROM v_seq WHERE k = 1
  UNION ALL
  SELECT s.key, s.k, s.e, s.us, CASE WHEN s.us - f.us >= 300000000 OR s.us - f.w >= 900000000 THEN s.us ELSE f.w END
  FROM f JOIN v_seq s ON s.key = f.key AND s.k = f.k + 1)
SELECT s.*, f.w, lag(s.ep) OVER (PARTITION BY s.key, f.w ORDER BY s.us, s.e) AS came
FROM f JOIN v_seq s ON s.key = f.key AND s.k = f.k"""
_sens = inn(V.SENSITIVE_ENDPOINTS)
VIEWS["v_peak"] = """
SELECT key, w, max(c) AS peak FROM (SELECT key, w, us // 60000000 AS m, count(*) AS c FROM v_win_ev GROUP BY 1, 2, 3) GROUP BY 1, 2"""
VIEWS["v_win0"] = f"""
SELECT key, w, max(us) AS last_us, count(*) AS n, count(came) AS tr,
  {cnt('came = ep')} AS same, {cnt(f'came NOT IN {_sens} AND ep IN {_sens}')} AS esc,
  {cnt("came <> 'decoy' AND ep = 'decoy'")} AS dec,
  max(lv_auto) AS a, max(lv_intent) AS i, max(lv_cont) AS c, max(lv_decoy) AS d,
  bit_or(CASE WHEN ch = 0 THEN 0 ELSE 1 << (ch - 1) END) AS fl,
  bool_or(coll <> 'complete') AS issue, bool_or(lab IN (1, 2)) AS hum, bool_or(lab = 3) AS ab,
  {', '.join(f"{cnt(f"ep = '{x}'")} AS ep_{x}" for x in V.LOCAL_ENDPOINTS)},
  {', '.join(f"{cnt(f"coll = '{x}'")} AS co_{x}" for x in V.COLLECTION_STATES)}
FROM v_win_ev GROUP BY 1, 2"""
VIEWS["v_win"] = """
SELECT x.*, peak,
  CASE WHEN n = 1 THEN 'single' WHEN peak >= 60 THEN 'high_rate' WHEN n >= 20 AND last_us - x.w <= 60000000 THEN 'clustered'
       WHEN n >= 20 AND last_us - x.w >= 300000000 THEN 'sustained' ELSE 'sparse' END AS shape,
  CASE WHEN peak = 1 THEN 'one' WHEN peak <= 5 THEN 'two_to_five' WHEN peak <= 20 THEN 'six_to_twenty'
       WHEN peak <= 59 THEN 'twenty_one_to_fifty_nine' ELSE 'sixty_plus' END AS pb,
  CASE WHEN hum AND ab THEN 'ambiguous' WHEN hum THEN 'human_confirmed' WHEN ab THEN 'operator_confirmed_abuse' ELSE 'unknown' END AS label,
  CASE WHEN bit_count(fl & 30) > 1 THEN 'conflicting' WHEN fl & 30 = 2 THEN 'passed' WHEN fl & 30 = 4 THEN 'failed'
       WHEN fl & 30 = 8 THEN 'abandoned' WHEN fl & 30 = 16 THEN 'fallback' WHEN fl & 1 = 1 THEN 'issued_unresolved' ELSE 'none' END AS chs,
  CASE WHEN nxt < last_us + 300000000 THEN 'maximum_duration' WHEN last_us + 300000000 <= (SELECT max(us) FROM v_local) THEN 'inactivity'
       ELSE 'end_of_input' END AS closure,
  CASE WHEN nxt < last_us + 300000000 THEN nxt ELSE last_us + 300000000 END AS closed
FROM (SELECT *, lead(w) OVER (PARTITION BY key ORDER BY w) AS nxt FROM v_win0) x JOIN v_peak p ON x.key = p.key AND x.w = p.w"""
QUERIES["e1_sequence_key"] = "SELECT key AS sequence_key, CAST(count(*) AS BIGINT) AS events FROM v_seq GROUP BY 1"
QUERIES["e2_sequence_windows"] = "SELECT e AS line_no, key AS sequence_key, w AS window_us FROM v_win_ev"
QUERIES["e3_closure_reason"] = "SELECT key AS sequence_key, w AS first_us, closure, closed AS closed_us FROM v_win"
QUERIES["e4_peak_minute"] = "SELECT key AS sequence_key, w AS first_us, peak AS peak_minute, pb AS peak_bucket FROM v_win"
QUERIES["e5_burst_shape"] = "SELECT shape AS burst_shape, count(*) AS n FROM v_win GROUP BY 1"
QUERIES["e6_endpoint_transitions"] = """
SELECT key AS sequence_key, w AS first_us, tr AS transitions, same AS same_class, esc AS sensitive_escalations, dec AS decoy_entries FROM v_win"""
QUERIES["e7_window_features"] = f"""
SELECT key AS sequence_key, w AS first_us, last_us, n AS events, issue AS collection_issue, CAST(a AS BIGINT) AS automation,
  CAST(i AS BIGINT) AS abuse_intent, CAST(c AS BIGINT) AS continuity, CAST(d AS BIGINT) AS decoy, CAST(fl AS BIGINT) AS challenge_flags,
  {', '.join(f'ep_{x} AS events_{x}' for x in V.LOCAL_ENDPOINTS)} FROM v_win"""
QUERIES["e8_challenge_state"] = "SELECT chs AS challenge_state, count(*) AS n FROM v_win GROUP BY 1"
QUERIES["e9_window_label"] = "SELECT label, count(*) AS n FROM v_win GROUP BY 1"


def _report_rows() -> list[tuple[str, str, str]]:
    rows = [("source", "events", "sum(n)"), ("windows", "total", "count(*)")]
    by = lambda sec, column, values: [(sec, v, f"count(*) FILTER (WHERE {column} = '{v}')") for v in values]
    rows += by("windows", "closure", ("inactivity", "maximum_duration", "end_of_input"))
    rows += by("burst_shapes", "shape", ("single", "sparse", "clustered", "sustained", "high_rate"))
    rows += by("peak_minute_events", "pb", ("one", "two_to_five", "six_to_twenty", "twenty_one_to_fifty_nine", "sixty_plus"))
    rows += [("transitions", b, x) for b, x in (("total", "sum(tr)"), ("same_class", "sum(same)"), ("cross_class", "sum(tr - same)"),
             ("sensitive_escalation", "sum(esc)"), ("decoy_entry", "sum(dec)"))]
    for x in V.LOCAL_ENDPOINTS:
        rows += [("endpoint_events", x, f"sum(ep_{x})"), ("endpoint_windows", x, f"count(*) FILTER (WHERE ep_{x} > 0)")]
    rows += [("collection_events", x, f"sum(co_{x})") for x in V.COLLECTION_STATES]
    rows += [("collection_windows", "clean", "count(*) FILTER (WHERE NOT issue)"), ("collection_windows", "with_artifact", "count(*) FILTER (WHERE issue)")]
    for sec, column, values in (("automation", "a", V.LEVELS), ("abuse_intent", "i", V.LEVELS), ("continuity", "c", V.LEVELS), ("decoys", "d", V.DECOY_LEVELS)):
        rows += [(sec, v, f"count(*) FILTER (WHERE {column} = {k})") for k, v in enumerate(values)]
    rows += by("challenges", "chs", ("none", "issued_unresolved", "passed", "failed", "abandoned", "fallback", "conflicting"))
    return rows + by("labels", "label", ("unknown", "human_confirmed", "operator_confirmed_abuse", "ambiguous"))


QUERIES["e10_sequence_report"] = "\nUNION ALL ".join(
    f"SELECT '{s}' AS section, '{b}' AS bucket, CAST(coalesce({x}, 0) AS BIGINT) AS n FROM v_win" for s, b, x in _report_rows())
QUERIES["e11_peak_active"] = """
SELECT CAST(max(c) AS BIGINT) AS peak_active FROM (
  SELECT sum(d) OVER (ORDER BY us, d ROWS UNBOUNDED PRECEDING) AS c FROM (
    SELECT w AS us, 1 AS d FROM v_win UNION ALL SELECT closed, -1 FROM v_win))"""
QUERIES["e12_check_sequence_report"] = "SELECT unnest(" + lst((
    "burst_shapes_sum_to_windows", "peak_minute_events_sum_to_windows", "collection_windows_sum_to_windows",
    "automation_sum_to_windows", "abuse_intent_sum_to_windows", "continuity_sum_to_windows", "decoys_sum_to_windows",
    "challenges_sum_to_windows", "labels_sum_to_windows", "closures_sum_to_windows", "endpoint_events_sum_to_events",
    "collection_events_sum_to_events", "transitions_plus_windows_is_events", "same_plus_cross_is_transitions",
    "escalations_within_cross", "decoy_entries_within_cross", "endpoint_windows_within_windows", "empty_together",
)) + ") AS check_name, (SELECT sum(tr) + count(*) = sum(n) AND sum(n) = (SELECT count(*) FROM events) FROM v_win) AS ok"

# --- F: holdout ----------------------------------------------------------------------------
VIEWS["v_fam"] = """
SELECT DISTINCT CASE WHEN sess IS NOT NULL THEN 'session:' || sess ELSE 'subject:' || subj END AS key,
  sha256(encode('evidentry-family-v1') || unhex('00') || encode('family-' || (CASE WHEN g % 4 = 0 THEN g % 11 ELSE g // 4 + 100 END)::VARCHAR)) AS family FROM v_local WHERE g % 2 = 0"""
VIEWS["v_part"] = """
SELECT w.*, f.family, CASE WHEN last_us < cut THEN 'baseline' WHEN w.w >= cut THEN 'holdout' ELSE 'boundary' END AS part
FROM v_win w LEFT JOIN v_fam f ON w.key = f.key, (SELECT (min(us) + max(us)) // 2 AS cut FROM v_local)"""
VIEWS["v_unseen"] = """
SELECT DISTINCT family FROM v_part WHERE part = 'holdout' AND family IS NOT NULL
  AND family NOT IN (SELECT family FROM v_part WHERE part = 'baseline' AND family IS NOT NULL)"""
VIEWS["v_split"] = """
SELECT *, part = 'holdout' AND family IS NOT NULL AND family IN (SELECT family FROM v_unseen) AS unseen FROM v_part"""
QUERIES["f1_load_families"] = """
WITH a AS (SELECT event_id AS e, event_id % 23 = 0 AS dev,
    CASE WHEN event_id % 3 = 0 THEN 'id' || (event_id // 2)::VARCHAR WHEN event_id % 29 = 0 THEN 'short' ELSE 'e' || event_id::VARCHAR END AS sid,
    CASE WHEN event_id % 19 = 0 THEN 'schema_version' WHEN event_id % 23 = 0 THEN 'sequence_kind'
         WHEN event_id % 3 <> 0 AND event_id % 29 = 0 THEN 'sequence_id' WHEN event_id % 31 = 0 THEN 'family_ref' END AS bad FROM events),
s AS (SELECT dev, sid, bad, count(*) AS c FROM a GROUP BY 1, 2, 3)
SELECT coalesce(bad, CASE WHEN c > 1 THEN 'duplicate_sequence' ELSE 'valid' END) AS reason,
  CAST(count(*) AS BIGINT) AS sequences, CAST(sum(c) AS BIGINT) AS records FROM s GROUP BY 1"""
QUERIES["f2_split_windows"] = """
SELECT part, label, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM v_part GROUP BY 1, 2"""
QUERIES["f3_attach_families"] = "SELECT family IS NOT NULL AS annotated, label, count(*) AS windows FROM v_part GROUP BY 1, 2"
QUERIES["f4_unseen_families"] = "SELECT family FROM v_unseen"
_rules = {"burst_behavior": "shape IN ('clustered','high_rate')", "automation_high": "a = 3", "abuse_intent_high": "i = 3",
          "active_decoy": "d >= 2"}
_rules["combined_candidate"] = " OR ".join(f"({x})" for x in _rules.values())
VIEWS["v_rules"] = "\nUNION ALL ".join(f"SELECT *, '{r}' AS rule, ({x}) AS flagged FROM v_split" for r, x in _rules.items())
QUERIES["f5_rule_matches"] = "SELECT rule, flagged, count(*) AS windows FROM v_rules GROUP BY 1, 2"
_labels = ("unknown", "human_confirmed", "operator_confirmed_abuse", "ambiguous")
VIEWS["v_scope"] = "\nUNION ALL ".join(
    f"SELECT '{p}' AS partition, '{ep}' AS endpoint_class, rule, flagged, label FROM v_rules WHERE {cond} AND {seen}"
    for p, cond in (("baseline", "part = 'baseline'"), ("holdout", "part = 'holdout'"), ("unseen_family_holdout", "unseen"))
    for ep, seen in [("all", "true"), *[(x, f"ep_{x} > 0") for x in V.LOCAL_ENDPOINTS]])
VIEWS["v_grid"] = f"""
SELECT p AS partition, ep AS endpoint_class, r AS rule FROM (SELECT unnest(['baseline','holdout','unseen_family_holdout']) AS p),
  (SELECT unnest({lst(('all', *V.LOCAL_ENDPOINTS))}) AS ep), (SELECT unnest({lst(_rules)}) AS r)"""
VIEWS["v_conf"] = f"""
SELECT g.partition, g.endpoint_class, g.rule, {', '.join(
    f"CAST(count(*) FILTER (WHERE {'flagged' if f == 'flagged' else 'NOT flagged'} AND label = '{v}') AS BIGINT) AS {f}_{v}"
    for f in ('flagged', 'unflagged') for v in _labels)}
FROM v_grid g LEFT JOIN v_scope s ON g.partition = s.partition AND g.endpoint_class = s.endpoint_class AND g.rule = s.rule
GROUP BY 1, 2, 3"""
QUERIES["f6_rule_confusion"] = "SELECT *, " + rates({
    "human_flag": ("flagged_human_confirmed", "flagged_human_confirmed + unflagged_human_confirmed"),
    "abuse_capture": ("flagged_operator_confirmed_abuse", "flagged_operator_confirmed_abuse + unflagged_operator_confirmed_abuse"),
    "unknown_flag": ("flagged_unknown", "flagged_unknown + unflagged_unknown")}) + " FROM v_conf"


def _holdout_columns() -> str:
    ab = "label = 'operator_confirmed_abuse' AND part <> 'boundary'"
    out = [f"{cnt('true')} AS windows", "CAST(sum(n) AS BIGINT) AS events", f"{cnt('family IS NOT NULL')} AS annotated_windows",
           f"{cnt('family IS NULL')} AS unannotated_windows", f"{cnt(f'family IS NOT NULL AND {ab}')} AS annotated_abuse_windows",
           f"{cnt(f'family IS NULL AND {ab}')} AS unannotated_abuse_windows",
           "count(DISTINCT family) FILTER (WHERE part = 'baseline') AS baseline_families",
           "count(DISTINCT family) FILTER (WHERE part = 'holdout') AS holdout_families",
           "count(DISTINCT family) FILTER (WHERE unseen) AS unseen_families"]
    for p, cond in (("baseline", "part = 'baseline'"), ("holdout", "part = 'holdout'"), ("unseen", "unseen"), ("boundary", "part = 'boundary'")):
        out += [f"{cnt(cond)} AS {p}_windows", f"CAST(coalesce(sum(n) FILTER (WHERE {cond}), 0) AS BIGINT) AS {p}_events",
                f"{cnt(f'{cond} AND issue')} AS {p}_with_artifact"]
        out += [f"{cnt(f'{cond} AND label = {chr(39)}{v}{chr(39)}')} AS {p}_{v}" for v in _labels]
    return ", ".join(out)


VIEWS["v_hreport"] = f"SELECT {_holdout_columns()} FROM v_split"
QUERIES["f6_holdout_report"] = "SELECT * FROM v_hreport"
QUERIES["f7_holdout_readiness"] = """
SELECT CASE WHEN baseline_windows = 0 OR holdout_windows = 0 THEN 'insufficient_chronological_partitions'
    WHEN len(b) > 0 THEN 'insufficient_confirmed_labels' WHEN fam IS NULL THEN 'chronological_and_unseen_family_ready'
    ELSE 'chronological_holdout_ready' END AS state, array_to_string(list_filter(list_append(b, fam), lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT *, list_filter([CASE WHEN baseline_windows = 0 THEN 'baseline_empty' END, CASE WHEN holdout_windows = 0 THEN 'holdout_empty' END,
    CASE WHEN baseline_human_confirmed < 5 THEN 'baseline_confirmed_human_below_minimum' END,
    CASE WHEN baseline_operator_confirmed_abuse < 5 THEN 'baseline_confirmed_abuse_below_minimum' END,
    CASE WHEN holdout_human_confirmed < 5 THEN 'holdout_confirmed_human_below_minimum' END,
    CASE WHEN holdout_operator_confirmed_abuse < 5 THEN 'holdout_confirmed_abuse_below_minimum' END], lambda x: x IS NOT NULL) AS b,
  CASE WHEN unannotated_abuse_windows <> 0 THEN 'family_confirmed_abuse_annotations_incomplete'
       WHEN unseen_operator_confirmed_abuse < 2 THEN 'unseen_family_confirmed_abuse_below_minimum' END AS fam FROM v_hreport)"""
QUERIES["f8_check_holdout_report"] = "SELECT unnest(" + lst((
    "windows_sum_to_source", "events_sum_to_source", "annotated_plus_unannotated", "abuse_split_by_annotation",
    "unseen_families_within_holdout", "unseen_within_holdout", "baseline_labels_sum", "holdout_labels_sum", "unseen_labels_sum",
    "boundary_labels_sum", "unseen_unknown_within_holdout", "unseen_human_confirmed_within_holdout",
    "unseen_operator_confirmed_abuse_within_holdout", "unseen_ambiguous_within_holdout", "rules_share_labels",
    "rates_within_intervals", "labels_are_the_reports", "endpoints_within_all", "rates_recomputed")) + ") AS check_name, (SELECT baseline_windows + holdout_windows + boundary_windows = windows FROM v_hreport) AS ok"

# --- G: decisions and outcomes --------------------------------------------------------------


def _kinds() -> str:
    return ", ".join(f"{cnt(f"outcome = '{o}'")} AS {o}" for o in V.OUTCOMES)


_actions = ", ".join(f"{cnt(f"{col} = '{a}'")} AS {p}_{a}" for p, col in (("enforced", "action"), ("computed", "computed")) for a in V.ACTIONS)
VIEWS["v_dsum"] = f"""
SELECT {cnt('true')} AS decisions, {_actions}, {', '.join(f"{cnt(f"mode = '{m}'")} AS mode_{m}" for m in V.MODES)},
  {cnt(f"mode = 'shadow' AND action IN {RISKY}")} AS shadow_risky_enforcements FROM v_dec"""
QUERIES["g1_decision_summary"] = f"SELECT *, {r9(rate('computed_challenge', 'decisions'))} AS computed_challenge_rate FROM v_dsum"
VIEWS["v_osum"] = f"SELECT {cnt('true')} AS outcomes, {_kinds()}, (SELECT CAST(count(*) AS BIGINT) FROM v_dec) AS decisions FROM v_out"
QUERIES["g2_outcome_summary"] = f"""
SELECT *, {r9('least(1.0, CAST(outcomes AS DOUBLE) / decisions)')} AS coverage,
  challenge_passed + challenge_failed + challenge_abandoned AS challenge_results,
  {r9(rate('(challenge_failed + challenge_abandoned)', 'challenge_passed + challenge_failed + challenge_abandoned'))} AS challenge_failure_rate
FROM v_osum"""
QUERIES["g3_score_summary"] = " UNION ALL ".join(
    f"SELECT '{n}' AS score, min({c}) AS minimum, max({c}) AS maximum, {r9(f'least(greatest(avg({c}), min({c})), max({c}))')} AS mean FROM v_dec"
    for n, c in (("automation_risk", "auto"), ("abuse_intent_risk", "intent"), ("account_continuity", "cont")))
VIEWS["v_eps"] = f"""
SELECT coalesce(d.ep, o.ep) AS endpoint_class, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('decisions', 'computed_risky', 'outcomes', *V.OUTCOMES))}
FROM (SELECT ep, {cnt('true')} AS decisions, {cnt(f'computed IN {RISKY}')} AS computed_risky FROM v_dec GROUP BY 1) d
FULL JOIN (SELECT ep, {cnt('true')} AS outcomes, {_kinds()} FROM v_out GROUP BY 1) o ON d.ep = o.ep"""
_res = "challenge_passed + challenge_failed + challenge_abandoned"
QUERIES["g4_endpoint_summary"] = f"""SELECT *, human_confirmed + operator_confirmed_abuse AS confirmed_labels, {rates({
    'computed_risky': ('computed_risky', 'decisions'), 'challenge_failure': ('(challenge_failed + challenge_abandoned)', _res),
    'challenge_abandonment': ('challenge_abandoned', _res), 'fallback_share': ('fallback_used', 'outcomes'),
    'appeal_share': ('appeal_requested', 'outcomes'), 'unknown_share': ('unknown', 'outcomes'),
    'abuse_label': ('operator_confirmed_abuse', 'human_confirmed + operator_confirmed_abuse')})} FROM v_eps"""
VIEWS["v_reason"] = "SELECT e, copy, unnest(reasons) AS value FROM v_dec"
QUERIES["g5_top_counts"] = """
SELECT value, CAST(count(*) AS BIGINT) AS n FROM v_reason GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
QUERIES["g6_distinct_budget"] = """
SELECT 'reason_codes' AS metadata, count(DISTINCT value) AS distinct_values, CAST(256 AS BIGINT) AS allowed, count(DISTINCT value) <= 256 AS ok FROM v_reason
UNION ALL SELECT 'policy_version', count(DISTINCT policy), 256, count(DISTINCT policy) <= 256 FROM v_dec
UNION ALL SELECT 'rollout_id', count(DISTINCT rollout), 256, count(DISTINCT rollout) <= 256 FROM v_dec"""
_bits = "1 << (list_position(" + lst(V.OUTCOMES) + ", outcome) - 1)"
VIEWS["v_link"] = f"""
SELECT coalesce(d.did, o.did) AS did, d.did IS NOT NULL AS seen, coalesce(nd, 0) AS nd, coalesce(no, 0) AS no, coalesce(mask, 0) AS mask,
  coalesce(lo = hi AND lo = ep, false) AS matched, coalesce(no - kinds, 0) AS dup, coalesce(nd = 1, false) AS eligible,
  ep, cohort, rec, computed IN {RISKY} AS risky, action = 'challenge' AS challenged, mode, rollout,
  CASE WHEN d.did IS NOT NULL THEN coalesce(level::VARCHAR, 'unknown') END AS lvl, withheld
FROM (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY did) AS nd, row_number() OVER (PARTITION BY did ORDER BY ord) AS r FROM v_dec) WHERE r = 1) d
FULL JOIN (SELECT did, count(*) AS no, bit_or({_bits}) AS mask, count(DISTINCT outcome) AS kinds, min(ep) AS lo, max(ep) AS hi
           FROM v_out WHERE did IS NOT NULL GROUP BY 1) o ON d.did = o.did"""
QUERIES["g7_link_outcomes"] = """
SELECT did AS decision_id, seen AS decision_seen, CAST(nd AS BIGINT) AS decision_records, CAST(no AS BIGINT) AS outcome_events,
  CAST(mask AS BIGINT) AS outcome_mask, matched, CAST(dup AS BIGINT) AS duplicate_outcomes, eligible, ep AS endpoint_class,
  cohort AS evaluation_cohort, risky AS predicted_risky, challenged, rollout AS rollout_id, lvl AS assurance_level,
  withheld AS assurance_withheld FROM v_link"""
_h, _a = 1 << V.OUTCOMES.index("human_confirmed"), 1 << V.OUTCOMES.index("operator_confirmed_abuse")
_t = sum(1 << V.OUTCOMES.index(o) for o in V.TERMINAL_OUTCOMES)
VIEWS["v_lsum"] = f"""
SELECT {cnt('seen')} AS unique_decision_ids, {cnt('nd > 1')} AS duplicate_decision_ids,
  CAST(sum(nd - 1) FILTER (WHERE seen) AS BIGINT) AS duplicate_decision_records, CAST(sum(no) AS BIGINT) AS outcomes_with_id,
  CAST(coalesce(sum(no) FILTER (WHERE seen AND matched), 0) AS BIGINT) AS matched_outcomes,
  CAST(coalesce(sum(no) FILTER (WHERE NOT seen), 0) AS BIGINT) AS unknown_decision_outcomes,
  CAST(coalesce(sum(no) FILTER (WHERE seen AND NOT matched), 0) AS BIGINT) AS endpoint_mismatch_outcomes,
  CAST(sum(dup) AS BIGINT) AS duplicate_outcomes, {cnt(f'eligible AND matched AND mask & {_h | _a} IN ({_h}, {_a})')} AS confirmed_labels,
  {cnt(f'eligible AND matched AND mask & {_h | _a} = {_h | _a}')} AS ambiguous_ground_truth,
  (SELECT CAST(count(*) AS BIGINT) FROM v_out WHERE did IS NULL) AS outcomes_without_id FROM v_link"""
QUERIES["g8_linkage_summary"] = f"""SELECT *, {rates({'label_coverage': ('confirmed_labels', 'unique_decision_ids + duplicate_decision_records')})} FROM v_lsum"""
VIEWS["v_last"] = "SELECT max(rec) AS last_us FROM (SELECT rec FROM v_dec UNION ALL SELECT rec FROM v_out)"
VIEWS["v_flag"] = f"""
SELECT *, CASE WHEN matched THEN mask & {_h | _a} ELSE 0 END AS truth, CASE WHEN matched THEN mask & {_t} ELSE 0 END AS term,
  challenged AND rec <= last_us - 900000000 AS mature FROM v_link, v_last WHERE eligible"""


def _eval_counts() -> str:
    one = lambda o: f"mature AND term = {1 << V.OUTCOMES.index(o)}"
    items = {"decisions": "true", "confirmed_labels": f"truth IN ({_h}, {_a})", "true_positive": f"truth = {_a} AND risky",
             "false_positive": f"truth = {_h} AND risky", "true_negative": f"truth = {_h} AND NOT risky",
             "false_negative": f"truth = {_a} AND NOT risky", "ambiguous_ground_truth": f"truth = {_h | _a}", "mature_challenges": "mature",
             "challenge_passed": one("challenge_passed"), "challenge_failed": one("challenge_failed"),
             "challenge_abandoned": one("challenge_abandoned"), "fallback_used": one("fallback_used"),
             "unresolved_mature_challenges": "mature AND term = 0", "ambiguous_challenge_outcomes": "mature AND bit_count(term) > 1"}
    return ", ".join(f"{cnt(c)} AS {n}" for n, c in items.items())


_eval_rates = rates({
    "false_positive": ("false_positive", "false_positive + true_negative"), "abuse_recall": ("true_positive", "true_positive + false_negative"),
    "abuse_precision": ("true_positive", "true_positive + false_positive"), "challenge_pass": ("challenge_passed", "mature_challenges"),
    "challenge_failure": ("challenge_failed", "mature_challenges"), "challenge_abandonment": ("challenge_abandoned", "mature_challenges"),
    "fallback": ("fallback_used", "mature_challenges")})


def evaluation(keys: str, group: str, source: str = "v_flag") -> str:
    return f"SELECT *, {_eval_rates} FROM (SELECT {keys}{', ' if keys else ''}{_eval_counts()} FROM {source} {group})"


QUERIES["g9_linked_evaluation"] = evaluation("mode", "GROUP BY 1")
VIEWS["v_slices"] = evaluation("ep AS endpoint_class, cohort AS evaluation_cohort", "GROUP BY 1, 2") + " UNION ALL " + evaluation(
    "ep AS endpoint_class, 'all' AS evaluation_cohort", "GROUP BY 1")
QUERIES["g10_evaluation_slices"] = "SELECT * FROM v_slices"
QUERIES["g11_assurance_slices"] = evaluation(
    "ep AS endpoint_class, lvl AS assurance_level, withheld AS assurance_withheld", "GROUP BY 1, 2, 3")
VIEWS["v_canary"] = f"""
SELECT c.rollout AS rollout_id, c.ep AS endpoint_class, coalesce(sn, 0) > 0 AS comparable, coalesce(sn, 0) AS shadow_decisions,
  cn AS canary_decisions, coalesce(sr, 0) AS shadow_risky, cr AS canary_risky, ce AS canary_enforced
FROM (SELECT rollout, ep, {cnt('true')} AS cn, {cnt(f'computed IN {RISKY}')} AS cr, {cnt(f'action IN {RISKY}')} AS ce FROM v_dec WHERE mode = 'canary' GROUP BY 1, 2) c
LEFT JOIN (SELECT ep, {cnt('true')} AS sn, {cnt(f'computed IN {RISKY}')} AS sr FROM v_dec WHERE mode = 'shadow' GROUP BY 1) s ON c.ep = s.ep"""
QUERIES["g12_canary_comparison"] = f"""
SELECT *, {rates({'shadow_risky': ('shadow_risky', 'shadow_decisions'), 'canary_risky': ('canary_risky', 'canary_decisions'),
                  'canary_enforced': ('canary_enforced', 'canary_decisions')})},
  {r9(f"CASE WHEN comparable THEN {rate('canary_risky', 'canary_decisions')} - {rate('shadow_risky', 'shadow_decisions')} ELSE 0.0 END")} AS difference_estimate,
  {r9(f"CASE WHEN comparable THEN greatest(-1.0, {lower('canary_risky', 'canary_decisions')} - {upper('shadow_risky', 'shadow_decisions')}) ELSE 0.0 END")} AS difference_lower95,
  {r9(f"CASE WHEN comparable THEN least(1.0, {upper('canary_risky', 'canary_decisions')} - {lower('shadow_risky', 'shadow_decisions')}) ELSE 0.0 END")} AS difference_upper95
FROM v_canary"""
_bud = ("mature_challenges", "challenge_passed", "challenge_failed", "challenge_abandoned", "fallback_used",
        "unresolved_mature_challenges", "ambiguous_challenge_outcomes")
VIEWS["v_budget0"] = f"""
SELECT k.rollout AS rollout_id, k.ep AS endpoint_class, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _bud)},
  coalesce(challenge_passed + challenge_failed + challenge_abandoned + fallback_used, 0) AS terminal_outcomes
FROM (SELECT DISTINCT rollout, ep FROM v_dec WHERE mode = 'canary') k
LEFT JOIN (SELECT rollout, ep, {_eval_counts()} FROM v_flag WHERE mode = 'canary' GROUP BY 1, 2) e ON k.rollout = e.rollout AND k.ep = e.ep"""
VIEWS["v_budget"] = f"""SELECT *, {rates({'terminal_coverage': ('terminal_outcomes', 'mature_challenges'),
    'challenge_abandonment': ('challenge_abandoned', 'mature_challenges'), 'fallback': ('fallback_used', 'mature_challenges')})} FROM v_budget0"""
QUERIES["g13_canary_challenge_budget"] = "SELECT * FROM v_budget"
QUERIES["g14_wilson"] = f"""SELECT *, {rates({'risky': ('risky', 'total')})} FROM (
  SELECT sid AS session_key, {cnt('true')} AS total, {cnt(f'computed IN {RISKY}')} AS risky FROM v_dec GROUP BY 1)"""
QUERIES["g15_proportion_difference"] = f"""
SELECT endpoint_class, {r9(f"({rate('risky', 'total')}) - ({rate('r', 't')})")} AS difference_estimate,
  {r9(f"greatest(-1.0, ({lower('risky', 'total')}) - ({upper('r', 't')}))")} AS lower95,
  {r9(f"least(1.0, ({upper('risky', 'total')}) - ({lower('r', 't')}))")} AS upper95
FROM (SELECT ep AS endpoint_class, {cnt('true')} AS total, {cnt(f'computed IN {RISKY}')} AS risky FROM v_dec GROUP BY 1),
     (SELECT {cnt('true')} AS t, {cnt(f'computed IN {RISKY}')} AS r FROM v_dec)"""
VIEWS["v_metrics"] = f"""
SELECT d.decisions, shadow_risky_enforcements AS sre, {rate('computed_challenge', 'd.decisions')} AS ccr,
  {rate('l.confirmed_labels', 'l.unique_decision_ids + l.duplicate_decision_records')} AS cov,
  e.false_positive + e.true_negative AS hum, e.true_positive + e.false_negative AS ab, e.mature_challenges AS mature,
  {rate('(e.challenge_failed + e.challenge_abandoned + e.unresolved_mature_challenges + e.ambiguous_challenge_outcomes)', 'e.mature_challenges')} AS fric
FROM v_dsum d, v_lsum l, (SELECT {_eval_counts()} FROM v_flag) e"""
_rules7 = [("sre > 0", "FIX_SHADOW_ENFORCEMENT", "critical", "shadow_risky_enforcements", "sre", "0", "count"),
           ("decisions < 1000", "COLLECT_MORE_DECISIONS", "high", "decisions", "decisions", "1000", "count"),
           ("cov < 0.1", "IMPROVE_OUTCOME_COVERAGE", "high", "linked_label_coverage", "cov", "0.1", "ratio"),
           ("hum < 100", "EXPAND_CONFIRMED_HUMANS", "high", "linked_human_confirmed", "hum", "100", "count"),
           ("ab < 100", "EXPAND_CONFIRMED_ABUSE", "medium", "linked_operator_confirmed_abuse", "ab", "100", "count"),
           ("ccr > 0.05", "REVIEW_COMPUTED_CHALLENGE_RATE", "medium", "computed_challenge_rate", "ccr", "0.05", "ratio"),
           ("mature >= 100 AND fric > 0.1", "REDUCE_CHALLENGE_FRICTION", "high", "linked_challenge_friction_rate", "fric", "0.1", "ratio")]
_state5 = ("CASE WHEN sre > 0 THEN 'invalid_shadow_behavior' WHEN decisions < 1000 THEN 'collecting' "
           "WHEN cov < 0.1 OR hum < 100 OR ab < 100 THEN 'needs_labels' "
           "WHEN ccr > 0.05 OR (mature >= 100 AND fric > 0.1) THEN 'needs_tuning' ELSE 'operator_review_candidate' END")
VIEWS["v_ready"] = f"""
SELECT {_state5} AS state, CASE WHEN {_state5} = 'operator_review_candidate' THEN 'review_reversible_canary' ELSE 'remain_shadow' END AS operator_action,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n, *_ in _rules7)}], lambda x: x IS NOT NULL), ',') AS reasons,
  false AS automatic_enforcement FROM v_metrics"""
QUERIES["g16_readiness"] = "SELECT * FROM v_ready"
QUERIES["g16_recommendations"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS code, '{p}' AS priority, 'required' AS disposition, '{m}' AS metric, "
    f"{r9(f'CAST({o} AS DOUBLE)')} AS observed, {t}::DOUBLE AS threshold, '{u}' AS unit FROM v_metrics WHERE {c}"
    for i, (c, n, p, m, o, t, u) in enumerate(_rules7, 1)) + """
UNION ALL SELECT 8, CASE WHEN state = 'operator_review_candidate' THEN 'PREPARE_OPERATOR_REVIEW' ELSE 'KEEP_SHADOW_MODE' END,
  CASE WHEN state = 'operator_review_candidate' THEN 'low' ELSE 'high' END,
  CASE WHEN state = 'operator_review_candidate' THEN 'review_candidate' ELSE 'hold' END, 'automatic_enforcement', 0.0, 0.0, 'boolean' FROM v_ready"""
VIEWS["v_halfflag"] = """
SELECT *, CASE WHEN rec < (SELECT (min(rec) + max(rec)) // 2 FROM v_dec) THEN 'baseline' ELSE 'holdout' END AS part FROM v_flag"""
VIEWS["v_half"] = f"""
SELECT *, false_positive + true_negative AS confirmed_human, true_positive + false_negative AS confirmed_abuse,
  decisions - confirmed_labels - ambiguous_ground_truth AS unlabeled_decisions FROM (
  {evaluation("part AS partition, ep AS endpoint_class, cohort AS evaluation_cohort", "GROUP BY 1, 2, 3", "v_halfflag")}
  UNION ALL {evaluation("part AS partition, 'all' AS endpoint_class, 'all' AS evaluation_cohort", "GROUP BY 1", "v_halfflag")})"""
QUERIES["g17_decision_holdout"] = "SELECT * FROM v_half"
QUERIES["g18_decision_holdout_readiness"] = """
SELECT CASE WHEN r = '' THEN 'chronological_ready' ELSE 'insufficient_confirmed_labels' END AS state, r AS reasons FROM (
  SELECT array_to_string(list_filter([CASE WHEN bh < 10 THEN 'baseline_confirmed_human_below_minimum' END, CASE WHEN ba < 10 THEN 'baseline_confirmed_abuse_below_minimum' END,
    CASE WHEN hh < 10 THEN 'holdout_confirmed_human_below_minimum' END, CASE WHEN ha < 10 THEN 'holdout_confirmed_abuse_below_minimum' END], lambda x: x IS NOT NULL), ',') AS r
  FROM (SELECT max(confirmed_human) FILTER (WHERE partition = 'baseline') AS bh, max(confirmed_abuse) FILTER (WHERE partition = 'baseline') AS ba,
    max(confirmed_human) FILTER (WHERE partition = 'holdout') AS hh, max(confirmed_abuse) FILTER (WHERE partition = 'holdout') AS ha FROM v_half WHERE endpoint_class = 'all'))"""
QUERIES["g19_check_analysis_report"] = "SELECT unnest(" + lst((
    "enforced_sum", "computed_sum", "modes_sum", "shadow_risky_within_shadow", "outcome_kinds_sum", "endpoint_decisions_sum",
    "endpoint_outcomes_sum", "endpoint_risky_sum", "endpoint_kinds_sum", "decision_records", "outcome_records", "linked_outcomes",
    "duplicates_within_ids", "evaluated_decisions", "evaluated_labels", "evaluated_ambiguous", "slices_roll_up", "evaluation_parts_sum",
    "intervals_contain_rates", "rates_recomputed", "canary_sum", "budget_per_comparison", "source_counts")) + """) AS check_name,
  (SELECT unique_decision_ids + duplicate_decision_records = (SELECT count(*) FROM v_dec) FROM v_lsum) AS ok"""

QUERIES["g19_check_readiness"] = "SELECT unnest(" + lst((
    "readiness_is_one_row", "state_recomputed", "action_recomputed", "reasons_recomputed", "never_automatic", "recommendations_recomputed")) + """) AS check_name,
  (SELECT unique_decision_ids + duplicate_decision_records = (SELECT count(*) FROM v_dec) FROM v_lsum) AS ok"""
QUERIES["g19_check_decision_holdout"] = "SELECT unnest(" + lst((
    "two_partitions", "counts_not_negative", "decisions_are_eligible", "labels_are_linked", "ambiguous_are_linked", "confusion_sums", "confirmed_sums",
    "unlabeled_rest", "challenge_sums", "slices_roll_up", "slices_distinct", "slices_named", "state_recomputed", "reasons_recomputed",
    "never_automatic")) + """) AS check_name,
  (SELECT unique_decision_ids + duplicate_decision_records = (SELECT count(*) FROM v_dec) FROM v_lsum) AS ok"""

# --- D6..D8 -----------------------------------------------------------------------------------


def _dominant(column: str, kind: str) -> str:
    return (f"SELECT CASE WHEN ok THEN v ELSE 'none' END AS version, CASE WHEN ok THEN c ELSE 0 END AS n, decisions, ok, '{kind}' AS kind FROM ("
            f"SELECT v, c, t AS decisions, c >= t - t // 10 AS ok FROM (SELECT {column} AS v, CAST(count(*) AS BIGINT) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS t "
            f"FROM v_dec GROUP BY 1 ORDER BY c DESC, v LIMIT 1))")


VIEWS["v_dom"] = _dominant("policy", "policy") + " UNION ALL " + _dominant("model", "model")
QUERIES["d6_dominant_version"] = "SELECT * FROM v_dom"
VIEWS["v_best"] = f"""
SELECT e.endpoint_class, e.decisions, e.computed_risky, false_positive + true_negative AS linked_human, true_positive + false_negative AS linked_abuse
FROM v_eps e JOIN v_slices s ON e.endpoint_class = s.endpoint_class AND evaluation_cohort = 'all'
WHERE e.endpoint_class IN {inn(V.ROLLOUT_ENDPOINTS)} AND e.computed_risky > 0 AND false_positive + true_negative >= 2 AND true_positive + false_negative >= 2
ORDER BY CAST(e.computed_risky AS DOUBLE) / e.decisions, e.decisions DESC, e.endpoint_class LIMIT 1"""
QUERIES["d7_recommend_endpoint"] = "SELECT * FROM v_best"
VIEWS["v_window"] = "SELECT (max(rec) - min(rec)) // 1000000 AS secs FROM (SELECT rec FROM v_dec UNION ALL SELECT rec FROM v_out)"


def _dom(kind: str, expr: str) -> str:
    return f"(SELECT {expr} FROM v_dom WHERE kind = '{kind}')"


_gates = [
    ("REPORT_READINESS", "(SELECT state = 'operator_review_candidate' FROM v_ready)", "(SELECT state FROM v_ready)", "operator_review_candidate"),
    ("OBSERVATION_WINDOW", "(SELECT secs >= 86400 FROM v_window)", "(SELECT secs::VARCHAR FROM v_window)", "86400"),
    *[(f"{k.upper()}_VERSION_DOMINANCE", _dom(k, "ok"), _dom(k, "version || ':' || n::VARCHAR || '/' || decisions::VARCHAR"), "single_valid_version>=90%")
      for k in ("policy", "model")],
    ("ELIGIBLE_ENDPOINT_SCOPE", "(SELECT count(*) = 1 FROM v_best)",
     "coalesce((SELECT endpoint_class || ':risky=' || computed_risky::VARCHAR || '/' || decisions::VARCHAR || ',linked_human=' || linked_human::VARCHAR || ',linked_abuse=' || linked_abuse::VARCHAR FROM v_best), 'none')",
     "one_public_endpoint_with_risky_shadow_actions,human>=100,abuse>=100"),
]
VIEWS["v_pred"] = """
SELECT coalesce(b.endpoint_class, '') AS ep, coalesce(c.canary_decisions, 0) AS n, coalesce(k.mature_challenges, 0) AS mature,
  coalesce(terminal_coverage_lower95, 0.0) AS cl, coalesce(terminal_outcomes, 0) AS ct, coalesce(challenge_abandonment_upper95, 0.0) AS au,
  coalesce(challenge_abandoned, 0) AS ac, coalesce(fallback_upper95, 0.0) AS fu, coalesce(fallback_used, 0) AS fc
FROM (SELECT 1) one LEFT JOIN v_best b ON true
LEFT JOIN v_canary c ON c.rollout_id = 'canary-a' AND c.endpoint_class = b.endpoint_class
LEFT JOIN v_budget k ON k.rollout_id = 'canary-a' AND k.endpoint_class = b.endpoint_class"""
_p = lambda x: f"(SELECT {x} FROM v_pred)"
_shown = lambda label, b, k: _p(f"'{label}=' || printf('%.6f', {b}) || ',count=' || {k}::VARCHAR || '/' || mature::VARCHAR")
_more = [
    ("PREDECESSOR_ENDPOINT_CANARY", _p("n >= 1000"), _p("ep || ':' || n::VARCHAR"), "same_endpoint_decisions>=1000"),
    ("PREDECESSOR_CHALLENGE_SAMPLE", _p("mature >= 100"), _p("ep || ':' || mature::VARCHAR"), "same_rollout_endpoint_mature_challenges>=100"),
    ("CHALLENGE_OUTCOME_COVERAGE_BUDGET", _p("mature >= 100 AND cl >= 0.9"), _shown("lower95", "cl", "ct"), "lower95>=0.90"),
    ("CHALLENGE_ABANDONMENT_BUDGET", _p("mature >= 100 AND au <= 0.1"), _shown("upper95", "au", "ac"), "upper95<=0.10"),
    ("CHALLENGE_FALLBACK_BUDGET", _p("mature >= 100 AND fu <= 0.1"), _shown("upper95", "fu", "fc"), "upper95<=0.10")]


def _gate_sql(gates) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{g}' AS gate, CASE WHEN {ok} THEN 'pass' ELSE 'hold' END AS status, {seen} AS observed, '{need}' AS required"
        for i, (g, ok, seen, need) in enumerate(gates, 1))


QUERIES["d8_review_gates_canary"] = _gate_sql(_gates)
QUERIES["d8_review_gates_enforce"] = _gate_sql(_gates + _more)
for _stage, _points, _seconds in (("canary", 100, 86_400), ("enforce", 10_000, 43_200)):
    QUERIES[f"d8_proposal_{_stage}"] = f"""
SELECT CASE WHEN ok THEN 'review_candidate' ELSE 'hold' END AS state,
  CASE WHEN ok THEN (SELECT any_value(endpoint_class) FROM v_best) END AS endpoint_class, CASE WHEN ok THEN 'challenge' END AS max_action,
  CAST(CASE WHEN ok THEN {_points} END AS BIGINT) AS basis_points, CAST(CASE WHEN ok THEN {_seconds} END AS BIGINT) AS duration_seconds,
  false AS automatic_activation FROM (SELECT bool_and(status = 'pass') AS ok FROM ({QUERIES[f"d8_review_gates_{_stage}"]}))"""

# --- H: telemetry -------------------------------------------------------------------------------
QUERIES["h1_traffic_counters"] = f"SELECT {cnt('true')} AS decisions, {_actions} FROM v_dec"
QUERIES["h2_reason_counters"] = """
SELECT value AS code, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT e, copy, value FROM v_reason) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"""
VIEWS["v_posture"] = "SELECT " + ", ".join(
    [f"{cnt('true')} AS samples"] + [f"{cnt(f"{c} = '{v}'")} AS {n}_{v}" for n, c, vs in (
        ("protocol", "tproto", V.TRANSPORT_PROTOCOLS), ("security", "tsec", V.TRANSPORT_SECURITY), ("address", "tsrc", V.ADDRESS_SOURCES)) for v in vs]) + " FROM v_req"
QUERIES["h3_transport_posture"] = """
SELECT *, CASE WHEN samples = 0 THEN 'no_samples' WHEN protocol_unknown + security_plaintext + security_unknown + address_invalid_trusted_proxy + address_unknown > 0
  THEN 'attention' ELSE 'collecting' END AS state FROM v_posture"""
QUERIES["h4_crawler_identity"] = "SELECT *, CASE WHEN unqualified > 0 THEN 'attention' WHEN observations > 0 THEN 'collecting' ELSE 'no_samples' END AS state FROM (SELECT " + ", ".join(
    [f"{cnt('true')} AS observations", f"{cnt(CRAWLER)} AS qualified", f"{cnt(f'NOT {CRAWLER}')} AS unqualified"]
    + [f"{cnt(f"cclass = '{v}'")} AS class_{v}" for v in V.CRAWLER_CLASSES]
    + [f"{cnt(f"cver = '{v}'")} AS verification_{v}" for v in V.CRAWLER_VERIFICATIONS]) + " FROM v_req WHERE bot OR cclass <> 'unknown' OR cver <> 'unknown')"
VIEWS["v_cov0"] = """
SELECT e, src, us, rn, k - CASE WHEN e % 31 = 0 THEN 5 ELSE 0 END AS seq, done, CASE WHEN e % 37 = 0 THEN 1 ELSE 0 END AS late,
  CASE WHEN e % 29 = 0 THEN 50 ELSE 0 END AS drop, k, k - CASE WHEN e % 31 = 0 THEN 5 ELSE 0 END >= 1 AND e % 41 <> 0
    AND done >= 1704067200 + src*600 + CASE WHEN e % 37 = 0 THEN 1 ELSE 0 END AND done * 1000000 <= us + 60000000 AS ok
FROM (SELECT *, CASE WHEN rn % 3 = 0 THEN rn - 1 ELSE rn END AS k,
    CASE WHEN rn % 3 = 0 THEN before ELSE us END // 1000000 + CASE WHEN e % 43 = 0 THEN 120 ELSE 0 END AS done FROM (
  SELECT e, u % 7 AS src, us, row_number() OVER w AS rn, lag(us) OVER w AS before FROM v_ev WINDOW w AS (PARTITION BY u % 7 ORDER BY us, e)))"""
VIEWS["v_cov"] = """
WITH RECURSIVE f AS (
  SELECT DISTINCT src, 0::BIGINT AS rn, -1::BIGINT AS e, NULL::BIGINT AS seq, NULL::BIGINT AS done, NULL::INT AS late, NULL::BIGINT AS k, NULL::INT AS drop, '' AS verdict FROM v_cov0
  UNION ALL
  SELECT src, rn, e, CASE WHEN vd = 'accepted' THEN s2 ELSE seq END, CASE WHEN vd = 'accepted' THEN d2 ELSE done END,
    CASE WHEN vd = 'accepted' THEN l2 ELSE late END, CASE WHEN vd = 'accepted' THEN k2 ELSE k END, CASE WHEN vd = 'accepted' THEN p2 ELSE drop END, vd
  FROM (SELECT f.src, t.rn, t.e, f.seq, f.done, f.late, f.k, f.drop, t.seq AS s2, t.done AS d2, t.late AS l2, t.k AS k2, t.drop AS p2,
      CASE WHEN NOT t.ok THEN 'invalid' WHEN f.seq IS NULL THEN 'accepted'
           WHEN t.seq = f.seq AND t.done = f.done AND t.late = f.late AND
                list_transform(range(1, 10), lambda i: greatest(t.k*i - t.drop, 0)) = list_transform(range(1, 10), lambda i: greatest(f.k*i - f.drop, 0)) THEN 'unchanged'
           WHEN t.late = f.late AND t.seq > f.seq AND t.done >= f.done AND
                len(list_filter(range(1, 10), lambda i: greatest(t.k*i - t.drop, 0) < greatest(f.k*i - f.drop, 0))) = 0 THEN 'accepted'
           ELSE 'conflict' END AS vd
    FROM f JOIN v_cov0 t ON t.src = f.src AND t.rn = f.rn + 1))
SELECT * FROM f WHERE rn > 0"""
_src = "lower(substr(lpad(upper(to_hex(src)), 32, 'a'), 1, 32))"
QUERIES["h5_accept_coverage"] = f"SELECT {_src} AS source_id, e AS line_no, verdict FROM v_cov"
VIEWS["v_cov6"] = """
SELECT c.src, i, greatest(n.k*i - n.drop, 0) - CASE WHEN 1704067200 + c.src*600 + n.late < 1704067200 + 1800 THEN greatest(b.k*i - b.drop, 0) ELSE 0 END AS d
FROM (SELECT src, max(rn) AS hi, min(rn) AS lo FROM v_cov WHERE verdict = 'accepted' GROUP BY 1) c
JOIN v_cov n ON n.src = c.src AND n.rn = c.hi JOIN v_cov b ON b.src = c.src AND b.rn = c.lo, (SELECT unnest(range(1, 10)) AS i)"""
VIEWS["v_cov6s"] = f"""
SELECT list_extract({lst(V.ENDPOINT_CLASSES)}, i) AS endpoint_class, CAST(sum(d)*10 AS BIGINT) AS protected, CAST(sum(d)*4 AS BIGINT) AS evaluated,
  CAST(sum(d)*2 AS BIGINT) AS bypassed, CAST(sum(d) AS BIGINT) AS rejected, CAST(sum(d)*3 AS BIGINT) AS granted_retries FROM v_cov6 GROUP BY i"""
QUERIES["h6_origin_coverage"] = "SELECT * FROM v_cov6s"
QUERIES["h6_coverage_state"] = f"""
SELECT *, {r9('CASE WHEN protected > 0 THEN least(1.0, CAST(evaluated + granted_retries AS DOUBLE) / protected) ELSE 0.0 END')} AS decision_coverage,
  CASE WHEN bypassed + rejected > 0 THEN 'degraded' WHEN protected > 0 THEN 'collecting' WHEN sources > 0 THEN 'no_samples' ELSE 'unavailable' END AS state
FROM (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('protected', 'evaluated', 'bypassed', 'rejected', 'granted_retries'))} FROM v_cov6s),
  (SELECT count(*) AS sources, max(n.done) * 1000000 AS last_reported_us,
     min(greatest(1704067200 + c.src*600 + n.late, 1704067200 + 1800)) * 1000000 AS observed_since_us
   FROM (SELECT src, max(rn) AS hi FROM v_cov WHERE verdict = 'accepted' GROUP BY 1) c JOIN v_cov n ON n.src = c.src AND n.rn = c.hi)"""
VIEWS["v_rlog"] = f"""
SELECT e, us, 'source-' || (u % 5)::VARCHAR AS src, CASE WHEN e % 17 = 0 THEN 'other' ELSE {pick(V.ENDPOINT_CLASSES, '(e*7+u) % 9')} END AS ep,
  {pick(('evaluated', 'evaluated', 'bypassed', 'granted_retry', 'rejected', 'lost'), 'e % 6')} AS disp, e*7919 % 10007 + e % 13 * 500 AS lat,
  CASE WHEN e % 43 = 0 THEN 'timeout' WHEN e % 47 = 0 THEN 'status' END AS fail FROM v_ev"""
_disp = {"protected": "true", "evaluated": "disp = 'evaluated'", "bypassed": "disp = 'bypassed'", "rejected": "disp IN ('rejected', 'lost')",
         "granted_retries": "disp = 'granted_retry'"}
QUERIES["h7_request_dispositions"] = "SELECT src AS source_id, ep AS endpoint_class, " + ", ".join(f"{cnt(c)} AS {n}" for n, c in _disp.items()) + " FROM v_rlog GROUP BY 1, 2"
QUERIES["h7_running_dispositions"] = "SELECT e AS line_no, ep AS endpoint_class, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE {c}) OVER w AS BIGINT) AS {n}" for n, c in _disp.items()) + " FROM v_rlog WINDOW w AS (PARTITION BY src, ep ORDER BY us, e ROWS UNBOUNDED PRECEDING)"
_stage = {"context_proofs": "e % 7 = 0", "accepted_batches": "e % 7 IN (1, 2)", "recorded_decisions": "e % 7 = 3",
          "rejected_before_ingest": "e % 7 = 4", "dropped_after_ingest": "e % 7 = 5"}
QUERIES["h8_collection_funnel"] = f"""
SELECT *, {r9('CASE WHEN accepted_batches > 0 THEN least(1.0, CAST(recorded_decisions AS DOUBLE) / accepted_batches) ELSE 0.0 END')} AS batch_recording_rate,
  CASE WHEN rejected_before_ingest + dropped_after_ingest > 0 THEN 'degraded' WHEN accepted_batches > 0 THEN 'collecting' ELSE 'no_samples' END AS state
FROM (SELECT {', '.join(f'{cnt(c)} AS {n}' for n, c in _stage.items())} FROM v_ev)"""
QUERIES["h9_outcome_flow"] = f"""
SELECT *, CASE WHEN rejected + dropped > 0 THEN 'degraded' WHEN accepted > 0 THEN 'collecting' ELSE 'no_samples' END AS state
FROM (SELECT {cnt('e % 4 < 2')} AS accepted, {cnt('e % 4 = 2')} AS rejected, {cnt('e % 4 = 3')} AS dropped FROM v_ev)"""
_ranks = ", ".join(f"CAST(quantile_disc(lat, {p / 100}) AS BIGINT) AS p{p}" for p in (50, 95, 99))
QUERIES["h10_latency_summary"] = f"""
SELECT *, {r9('n / (elapsed_us / 1e6)')} AS throughput FROM (SELECT CAST(count(*) AS BIGINT) AS n, {_ranks}, max(lat) AS max,
  {cnt('fail IS NOT NULL')} AS failures, max(us) - min(us) AS elapsed_us FROM v_rlog)"""
QUERIES["h10_nearest_rank"] = f"SELECT src AS source_id, CAST(count(*) AS BIGINT) AS n, {_ranks}, max(lat) AS max FROM v_rlog GROUP BY 1"
QUERIES["h10_failure_counts"] = "SELECT fail AS failure_class, CAST(count(*) AS BIGINT) AS n FROM v_rlog WHERE fail IS NOT NULL GROUP BY 1"
QUERIES["h10_run_spread"] = """
SELECT source_id, median(p) AS median, min(p) AS minimum, max(p) AS maximum FROM (
  SELECT src AS source_id, us // 3600000000 AS h, quantile_disc(lat, 0.5) AS p FROM v_rlog GROUP BY 1, 2) GROUP BY 1"""

# --- A: sources and sinks; J: streams ---------------------------------------------------------
QUERIES["a1_read_evidence_jsonl"] = """
SELECT CASE WHEN e % 83 = 0 THEN 'invalid_json' WHEN e % 89 = 0 THEN 'duplicate_key' WHEN e % 97 = 0 THEN 'unknown_field'
  ELSE coalesce(why, 'valid') END AS reason, CAST(count(*) AS BIGINT) AS n FROM v_local_bad GROUP BY 1"""
QUERIES["a4_publish_evidence"] = "SELECT CAST(count(*) AS BIGINT) AS events, min(us) AS first_us, max(us) AS last_us FROM v_local"
QUERIES["a4_shard_contents"] = """
SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(('0x' || substr(sha256(concat_ws('|', e, us, coalesce(subj, ''), coalesce(sess, ''), ep)), 1, 15))::BIGINT) AS VARCHAR) AS digest,
  false AS too_large, CAST(0 AS BIGINT) AS overlaps FROM v_local"""
QUERIES["a5_import_faults"] = """
WITH lines AS (SELECT e, us // 1000000 AS s, CASE WHEN e % 83 = 0 THEN 'invalid_json' WHEN e % 97 = 0 THEN 'unknown_field' ELSE why END AS reason FROM v_local_bad),
late AS (SELECT count(*) AS n FROM (SELECT s, lag(s) OVER (ORDER BY e) AS p FROM lines WHERE reason IS NULL) WHERE s < p)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM lines WHERE reason IS NULL) AS events, (SELECT CAST(count(*) AS BIGINT) FROM lines WHERE reason IS NOT NULL) AS quarantined,
  (SELECT CAST(n AS BIGINT) FROM late) AS out_of_order, reason, CAST(count(*) AS BIGINT) AS n FROM lines WHERE reason IS NOT NULL GROUP BY reason"""
QUERIES["a5_verify_published"] = "SELECT CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS problems FROM v_local"
QUERIES["a5_import_evidence"] = f"""
SELECT 'dataset-a' AS dataset, 'pilot-a' AS pilot, '{domain_id(domain_key(b"k" * 32, "dataset-a", "pilot-a"))}' AS domain_id,
  'evidentry.local-input.v1' AS schema_version, CAST(count(*) AS BIGINT) AS events, min(us) // 1000000 * 1000000 AS first_us,
  max(us) // 1000000 * 1000000 AS last_us, CAST(0 AS BIGINT) AS quarantined, CAST(0 AS BIGINT) AS out_of_order,
  CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS problems FROM v_local_bad WHERE why IS NULL"""
QUERIES["a13_sealed_records"] = "SELECT e AS line_no, disp AS disposition FROM v_rlog WHERE (e // 5) % 50 <> 7"
QUERIES["a13_check_counters"] = """
SELECT (e % 5)::VARCHAR AS source, CAST(count(*) AS BIGINT) AS records, e % 5 <> 3 AS contiguous FROM v_rlog WHERE e <> 23 GROUP BY e % 5"""
QUERIES["a15_publish_report"] = f"""
SELECT *, CASE WHEN rejected + dropped > 0 THEN 'degraded' WHEN accepted > 0 THEN 'collecting' ELSE 'no_samples' END AS state
FROM (SELECT {cnt('e % 4 < 2')} AS accepted, {cnt('e % 4 = 2')} AS rejected, {cnt('e % 4 = 3')} AS dropped FROM v_ev)"""
QUERIES["b3_assert_no_direct_refs"] = """
SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT subject_id) AS subjects, count(DISTINCT session_id) AS sessions FROM v_pseudo"""
VIEWS["v_stream_feat"] = features(f"""(SELECT e, us, 'session-' || lpad(CAST(u AS VARCHAR), CAST(greatest(8, length(CAST(u AS VARCHAR))) AS INTEGER), '0') AS sid,
  {pick(V.ENDPOINT_CLASSES, '(e*7+u) % 9')} AS ep, e + 1 - CASE WHEN e % 11 = 0 THEN 300 ELSE 0 END AS seq FROM v_ev)""")
# A row of the far future ends every stream, so all rows and windows come out.
QUERIES["j1_stream_session_features"] = """
SELECT sid AS session_id, e AS line_no, CAST(n_req AS BIGINT) AS request_count, first_us AS first_seen_us,
  CAST(max_gap AS BIGINT) AS max_sequence_gap, classes AS distinct_endpoint_classes, transitions AS endpoint_transitions
FROM v_stream_feat"""
QUERIES["j2_stream_event_batches"] = QUERIES["c4_ingest_event_batches"]
QUERIES["j3_stream_single_use"] = QUERIES["c24_audit_single_use"]
QUERIES["j4_stream_windows"] = """
SELECT key AS sequence_key, w AS first_us, last_us, n AS events, peak AS peak_minute, tr AS transitions,
  CASE closure WHEN 'end_of_input' THEN 'inactivity' ELSE closure END AS closure FROM v_win"""
QUERIES["j5_stream_link_outcomes"] = """
SELECT d.did AS decision_id, o.outcome FROM v_dec d LEFT JOIN v_out o
  ON o.did = d.did AND o.rec BETWEEN d.rec AND d.rec + 900000000 WHERE d.copy = 0"""
QUERIES["j6_stream_challenges"] = QUERIES["c27_challenge_lifecycle"]
QUERIES["j7_watch_report"] = QUERIES["g1_decision_summary"]
QUERIES["j8_stream_coverage"] = QUERIES["h5_accept_coverage"]
QUERIES["j9_stream_counters"] = """
SELECT us // 300000000 * 300000000 AS start_us, CAST(count(*) AS BIGINT) AS decisions FROM v_ev GROUP BY 1"""
QUERIES["j10_route_late"] = """
SELECT e AS line_no, e % 2 = 0 AND us < (SELECT max(us) FROM v_ev WHERE e % 2 = 1) AS late FROM v_ev"""
