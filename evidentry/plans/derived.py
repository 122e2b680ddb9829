"""Evidence tables derived from the driver's `events` table.

Only integer arithmetic is used, so the same rows can be derived by any SQL
engine. Every function reads the whole table. Some inputs are sparser than events by their
nature and say so: decoys exist for every fifth event, challenges for every seventh, liveness
attempts for every fourth, trust lists for one in 500, outcomes for a third of the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expr import micros
from ..functions.timeline import ranked
from .. import vocab as V

T0 = 1_704_067_200_000_000  # 2024-01-01 UTC in microseconds
COMPRESSION = 120
LOCAL_GROUPS = 100_000  # start times of local sequences repeat after 23 years, so dates stay valid at any size


def pick(values, index: Column) -> Column:
    """values[index] for a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def div(c: Column, n: int) -> Column:
    """Integer division of a non-negative column."""
    return ((c - c % n) / F.lit(n)).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id and the compressed time `us`."""
    return _compressed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream over the file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _compressed(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                       .parquet(sf_dir))


def _compressed(raw: DataFrame) -> DataFrame:
    us = micros("ts")
    return raw.select("event_id", "user_id",
                      (F.lit(T0) + div(us - T0, COMPRESSION)).alias("us"))


def _session(user: Column) -> Column:
    """Whole user id, padded to eight digits at least."""
    digits = user.cast("string")
    return F.concat(F.lit("session-"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.length(digits))), digits)


def requests(spark: SparkSession, sf_dir: str, change: dict | None = None) -> DataFrame:
    """Scoring requests, one per event; `change` maps observation names to functions."""
    change = change or {}
    e, u = F.col("event_id"), F.col("user_id")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    df = events(spark, sf_dir).withColumn("rn", rn.cast("long"))
    on = lambda n: e % n == 0
    unknown = F.lit("unknown")
    fields = {
        "user_agent_present": (e % 10 != 0),
        "browser_event_count": (e % 6).cast("int"),
        "browser_events_verified": (e % 2 == 0),
        "honeypot_hits": F.when(on(37), 1 + e % 3).otherwise(0).cast("int"),
        "verified_decoy_hits": F.lit(0),
        "challenge_verdict": F.when(on(31), F.lit("failed")).otherwise(unknown),
        "external_risk_score": F.when(on(23), (e % 100) / 100.0).otherwise(0.0),
        "policy_alert": on(29),
        "verified_bot": on(13),
        "crawler_class": F.when(on(13), pick(V.CRAWLER_CLASSES[1:7], div(e, 13) % 6)).otherwise(unknown),
        "crawler_verification": F.when(on(13), pick(V.CRAWLER_VERIFICATIONS[1:], div(e, 13) % 3)).otherwise(unknown),
        "transport_protocol": pick(V.TRANSPORT_PROTOCOLS, div(e, 3) % 4),
        "transport_security": pick(V.TRANSPORT_SECURITY, div(e, 5) % 4),
        "client_address_source": pick(V.ADDRESS_SOURCES, div(e, 7) % 4),
        "edge_fingerprint_class": F.when(on(17), pick(V.FINGERPRINT_CLASSES[1:], div(e, 17) % 3)).otherwise(unknown),
        "edge_fingerprint_method": F.when(on(17), pick(V.FINGERPRINT_METHODS[1:], div(e, 51) % 3)).otherwise(unknown),
        "network_reputation": F.when(e % 19 < 4, pick(V.NETWORK_REPUTATIONS, e % 19 % 4)).otherwise(unknown),
        "network_type": F.when(e % 21 < 7, pick(V.NETWORK_TYPES, e % 21 % 7)).otherwise(unknown),
        "server_session_verified": (u % 3 == 0),
    }
    fields = {k: (change[k](c) if k in change else c) for k, c in fields.items()}
    observations = F.struct(*[c.alias(k) for k, c in fields.items()])
    return df.select(
        F.timestamp_micros("us").alias("observed_at"), e.alias("line_no"),
        _session(u).alias("session_id"),
        pick(V.REQUEST_ACTIONS, e % 13).alias("action"),
        pick(V.ENDPOINT_CLASSES, (e * 7 + u) % 9).alias("endpoint_class"),
        F.when(u % 6 != 5, pick(V.COHORTS, u % 6)).alias("evaluation_cohort"),
        F.greatest(F.lit(1), F.col("rn") + 30 * div(F.col("rn"), 7)
                   - F.when(e % 11 == 0, 3).otherwise(0)).alias("sequence"),
        observations.alias("observations"),
        F.when(e % 50 == 0, F.lit("observe")).alias("expected_action"),
        F.when(e % 100 == 0, F.lit("block")).alias("expected_computed_action"),
    )


def busy_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`requests` as bursts: every 200 events share a session and follow at 250 ms."""
    e = F.col("line_no")
    g = div(e, 200)
    return requests(spark, sf_dir).withColumns({
        "session_id": _session(g), "sequence": e % 200 + 1,
        "observed_at": F.timestamp_micros(F.lit(T0) + g % 1_000_000 * V.MINUTE_US * 10 + e % 200 * 250_000)})


def rough_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`requests` with contract violations spread over the rows."""
    e, event = F.col("line_no"), F.col("event_id")
    instead = lambda k, v: lambda c: F.when(event % k == 0, F.lit(v)).otherwise(c)
    df = requests(spark, sf_dir, {
        "browser_event_count": instead(53, 10_001), "honeypot_hits": instead(59, -1),
        "external_risk_score": instead(61, 1.5), "crawler_class": instead(26, "unknown"),
        "edge_fingerprint_method": instead(34, "unknown"), "transport_protocol": instead(67, "http9")})
    return df.withColumns({
        "session_id": F.when(e % 43 == 0, F.lit("short")).otherwise(F.col("session_id")),
        "action": F.when(e % 47 == 0, F.lit("dance")).otherwise(F.col("action")),
        "sequence": F.when(e % 71 == 0, F.lit(0)).otherwise(F.col("sequence")),
        "evaluation_cohort": F.when(e % 73 == 0, F.lit("vip")).otherwise(F.col("evaluation_cohort")),
    })


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser batches, one per event, with overlapping sequences and bad batches."""
    e, u = F.col("event_id"), F.col("user_id")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    df = events(spark, sf_dir).withColumn("rn", rn.cast("long"))
    first = F.greatest(F.lit(1), 2 * F.col("rn") - e % 3)
    item = lambda j: F.struct(
        (first + j).alias("sequence"), (e % 1000 * 10 + j).alias("elapsed_bucket_ms"),
        F.when(e % 41 == 0, F.lit("keyboard"))
        .otherwise(pick(V.BROWSER_EVENT_KINDS, (e + j) % 5)).alias("kind"),
        ((e + j) % 100).alias("value_bucket"))
    return df.select(
        _session(u).alias("session_id"), F.lit("sensor-1").alias("sensor_version"),
        F.timestamp_micros("us").alias("received_at"), e.alias("line_no"),
        F.transform(F.sequence(F.lit(0).cast("long"), e % 5), item).alias("events"),
        (e % 10 != 0).alias("user_agent_present"), (u % 3 == 0).alias("verified_session"))


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream; the sequence is the event id, as a stream has no rank."""
    e, u = F.col("event_id"), F.col("user_id")
    return event_stream(spark, sf_dir).select(
        F.timestamp_micros("us").alias("observed_at"), e.alias("line_no"), _session(u).alias("session_id"),
        pick(V.ENDPOINT_CLASSES, (e * 7 + u) % 9).alias("endpoint_class"),
        (e + 1 - F.when(e % 11 == 0, 300).otherwise(0)).alias("sequence"))


def local_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised local evidence as a stream."""
    return _local(event_stream(spark, sf_dir)).withColumnsRenamed(
        {"subject_ref": "subject_id", "session_ref": "session_id"})


def local_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local evidence before validation and pseudonymisation."""
    return _local(events(spark, sf_dir))


def _local(source: DataFrame) -> DataFrame:
    e = F.col("event_id")
    g, i = div(e, 100), e % 100
    v = g % 5
    start = F.lit(T0) + g % LOCAL_GROUPS * 7200 * V.MICROS
    offset = (F.when(v == 0, i * 500_000)
              .when((v == 1) & (i < 40), i * V.MICROS)
              .when(v == 1, (i - 40) * 20 * V.MICROS)
              .when(v == 2, i * 301 * V.MICROS)
              .when(v == 3, i * 30 * V.MICROS)
              .otherwise(i * 100 * V.MICROS))
    lane = F.when((v == 1) & (i >= 40), F.lit("b")).otherwise(F.lit("a"))
    ref = F.concat(F.lit("seq-"), g.cast("string"), F.lit("-"), lane)
    evidence = F.struct(
        F.when(e % 43 == 0, F.lit("missing")).when(e % 31 == 0, F.lit("partial"))
        .otherwise(F.lit("complete")).alias("collection_status"),
        F.when(e % 37 == 0, pick(V.LEVELS, div(e, 37) % 4)).otherwise(F.lit("none"))
        .alias("automation_evidence"),
        F.when(e % 41 == 0, pick(V.LEVELS, div(e, 41) % 4)).otherwise(F.lit("none"))
        .alias("abuse_intent_evidence"),
        F.when(e % 29 == 0, pick(V.LEVELS, div(e, 29) % 4)).otherwise(F.lit("none"))
        .alias("continuity_evidence"),
        F.when(e % 47 == 0, pick(V.DECOY_LEVELS, div(e, 47) % 4)).otherwise(F.lit("none"))
        .alias("decoy_interaction"),
        F.when(e % 23 == 0, pick(V.CHALLENGE_STATES, div(e, 23) % 6)).otherwise(F.lit("none"))
        .alias("challenge_lifecycle"))
    kind = (F.when(e % 53 == 0, F.lit(1)).when(e % 59 == 0, F.lit(2))
            .when(e % 61 == 0, F.lit(3)).otherwise(F.lit(0)))
    triple = lambda k: pick([t[k] for t in V.LABEL_TRIPLES], kind)
    return source.select(
        e.alias("line_no"), F.timestamp_micros(start + offset).alias("observed_at"),
        ref.alias("subject_ref"),
        F.when(g % 3 != 0, F.concat(F.lit("s-"), ref)).alias("session_ref"),
        pick(V.LOCAL_SOURCES, e % 6).alias("source"),
        pick(V.LOCAL_ENDPOINTS, div(e, 3) % 7).alias("endpoint_class"),
        pick(V.LOCAL_ACTIONS, e % 4).alias("action_class"),
        pick(V.STATUS_CLASSES, e % 5).alias("status_class"),
        evidence.alias("evidence"),
        F.struct(triple(0).alias("class"), triple(1).alias("provenance"),
                 triple(2).alias("confidence")).alias("label"))


def rough_local_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local evidence in input form (text time) with contract violations."""
    e = F.col("line_no")
    iso = F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    df = local_events_raw(spark, sf_dir)
    return df.withColumns({
        "schema_version": F.when(e % 101 == 0, F.lit("other.v1"))
        .otherwise(F.lit("evidentry.local-input.v1")),
        "observed_at": F.when(e % 103 == 0, F.regexp_replace(iso, "Z$", "+00:00")).otherwise(iso),
        "subject_ref": F.when(e % 107 == 0, F.concat(F.lit(" "), F.col("subject_ref")))
        .when(e % 109 == 0, F.lit("")).otherwise(F.col("subject_ref")),
        "source": F.when(e % 113 == 0, F.lit("spreadsheet")).otherwise(F.col("source")),
        "label": F.col("label").withField(
            "confidence", F.when(e % 127 == 0, F.lit("confirmed")).otherwise(F.col("label.confidence"))),
    })


def local_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local evidence in normalised form; references stand in for pseudonyms."""
    return local_events_raw(spark, sf_dir).withColumnsRenamed(
        {"subject_ref": "subject_id", "session_ref": "session_id"})


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family annotations of the even groups, one per sequence."""
    e = F.col("event_id")
    g = div(e, 100)
    raw = local_events_raw(spark, sf_dir).withColumn("g", div(F.col("line_no"), 100))
    session = F.col("session_ref").isNotNull()
    return (raw.filter(F.col("g") % 2 == 0)
            .select(F.when(session, F.lit("session")).otherwise(F.lit("subject")).alias("sequence_kind"),
                    F.coalesce("session_ref", "subject_ref").alias("sequence_id"),
                    F.concat(F.lit("family-"), F.when(F.col("g") % 4 == 0, F.col("g") % 11)
                             .otherwise(div(F.col("g"), 4) + 100).cast("string")).alias("family_ref"))
            .distinct())


def rough_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with duplicated sequences and contract violations, one per event."""
    e = F.col("event_id")
    ident = F.rpad(F.concat(F.lit("id"), div(e, 2).cast("string"), F.lit("-")), 43, "A")
    return events(spark, sf_dir).select(
        F.when(e % 19 == 0, F.lit("v0")).otherwise(F.lit("evidentry.family-annotation.v1"))
        .alias("schema_version"),
        F.when(e % 23 == 0, F.lit("device")).otherwise(F.lit("subject")).alias("sequence_kind"),
        F.when(e % 3 == 0, ident).when(e % 29 == 0, F.lit("short"))
        .otherwise(F.rpad(F.concat(F.lit("e"), e.cast("string"), F.lit("-")), 43, "A")).alias("sequence_id"),
        F.when(e % 31 == 0, F.lit(" padded")).otherwise(F.concat(F.lit("f-"), (e % 11).cast("string")))
        .alias("family_ref"))


def outcomes(decisions: DataFrame) -> DataFrame:
    """Delayed outcomes of logged decisions (see `logged_decisions`)."""
    from ..vocab import OUTCOMES, OUTCOME_TRIPLES

    e = F.col("line_no")
    first = {o: next(t for t in OUTCOME_TRIPLES if t[0] == o) for o in OUTCOMES}

    def rows(cond: Column, shift: int) -> DataFrame:
        kind = (div(e, 3) + shift) % 9
        wrong = pick(V.ENDPOINT_CLASSES, (e + 1) % 9)
        return decisions.filter(cond & (F.col("copy") == 0)).select(
            F.when(e % 99 == 0, F.lit(None)).when(e % 60 == 0, F.concat(F.lit("x-"), e.cast("string")))
            .otherwise(F.concat(F.lit("d-"), e.cast("string"))).alias("decision_id"),
            (F.col("recorded_at") + F.expr("INTERVAL 10 MINUTES")).alias("recorded_at"),
            F.when(e % 45 == 0, wrong).otherwise(F.col("endpoint_class")).alias("endpoint_class"),
            pick(OUTCOMES, kind).alias("outcome"),
            pick([first[o][1] for o in OUTCOMES], kind).alias("provenance"),
            pick([first[o][2] for o in OUTCOMES], kind).alias("confidence"))

    return rows(e % 3 == 0, 0).unionByName(rows(e % 15 == 0, 1))


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision log of the whole `events` table, scored in shadow mode."""
    from ..operators.decide import decide

    return logged_decisions(decide(requests(spark, sf_dir)))


def logged_decisions(decisions: DataFrame) -> DataFrame:
    """Decision-log rows from scored shadow decisions, with duplicated ids."""
    e = F.col("line_no")
    user = F.expr("substring(session_id, 9)").cast("long")
    canary = user % 4 == 0
    rollout = F.when(canary, F.when(user % 8 == 0, F.lit("canary-a")).otherwise(F.lit("canary-b")))
    copies = F.when(e % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return decisions.withColumn("copy", F.explode(copies)).select(
        "line_no", "copy", (e * 2 + F.col("copy")).alias("ingest_order"),
        F.concat(F.lit("d-"), e.cast("string")).alias("decision_id"),
        F.date_trunc("second", "observed_at").alias("recorded_at"),
        F.col("session_id").alias("session_key"),
        F.lit("other").alias("request_action"),
        "endpoint_class",
        pick(V.COHORTS, user % 6).alias("evaluation_cohort"),
        F.when(canary, F.col("computed_action")).otherwise(F.col("action")).alias("action"),
        "computed_action",
        F.when(canary, F.lit("canary")).otherwise(F.lit("shadow")).alias("mode"),
        rollout.alias("rollout_id"), "scores", "reason_codes",
        F.when(e % 20 == 0, F.lit("default-v4")).otherwise(F.col("policy_version")).alias("policy_version"),
        "model_version",
        F.when(e % 3 == 0, F.lit(None)).otherwise(e % 3 - 1).cast("int").alias("assurance_level"),
        ((e % 3 == 2) & (e % 5 == 0)).alias("assurance_withheld"))


LOG_KEY = b"log-key-for-derived-tables"


def log_records(decided: DataFrame) -> DataFrame:
    """Tagged-union log records of four generations, with contract violations."""
    from ..operators.contracts import LOG_VERSIONS
    from ..operators.pseudonym import session_key

    logged = logged_decisions(decided)
    e = F.col("line_no")
    version = pick(LOG_VERSIONS, e % 4)
    key = session_key("session_key", LOG_KEY)
    decision = F.struct(
        "decision_id", "request_action", "endpoint_class",
        F.when((e % 4 == 0) & (e % 89 != 0), F.lit(None)).otherwise(F.col("evaluation_cohort"))
        .alias("evaluation_cohort"),
        "action", "computed_action", "mode",
        F.when(e % 71 == 0, F.lit(None)).otherwise(F.col("rollout_id")).alias("rollout_id"),
        F.col("scores").withField("automation_risk", F.when(e % 61 == 0, 1.5)
                                  .otherwise(F.col("scores.automation_risk"))).alias("scores"),
        F.when(e % 67 == 0, F.array_append("reason_codes", F.lit("bad code")))
        .otherwise(F.col("reason_codes")).alias("reason_codes"),
        "policy_version", "model_version",
        F.when((e % 4 == 3) | (e % 83 == 0), F.col("assurance_level")).alias("assurance_level"),
        (F.col("assurance_withheld") & (e % 4 == 3) | (e % 79 == 0)).alias("assurance_withheld"))
    out = outcomes(logged)
    none = lambda df, c: F.lit(None).cast(df.select(c).schema[0].dataType)
    d = logged.select(
        "ingest_order", version.alias("schema_version"), F.lit("decision").alias("kind"),
        "recorded_at", F.when(e % 73 == 0, F.lit("short")).otherwise(key).alias("session_key"),
        F.when(e % 59 != 0, decision).alias("decision"))
    o = out.select(
        F.lit(-1).cast("long").alias("ingest_order"), F.lit(LOG_VERSIONS[3]).alias("schema_version"),
        F.lit("outcome").alias("kind"), "recorded_at", session_key(F.lit("any-session"), LOG_KEY)
        .alias("session_key"),
        F.struct("decision_id", "endpoint_class", "outcome",
                 F.when(F.minute("recorded_at") % 7 == 0, F.lit("user_feedback"))
                 .otherwise(F.col("provenance")).alias("provenance"), "confidence").alias("outcome"))
    return d.withColumn("outcome", none(o, "outcome")).unionByName(
        o.withColumn("decision", none(d, "decision")))


# --- inputs of the identity operators ---------------------------------------------------

def decoy_issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decoy capability per fifth event."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).filter(e % 5 == 0).select(
        F.concat(F.lit("cap-"), e.cast("string")).alias("capability"), _session(u).alias("session_id"),
        pick(V.ENDPOINT_CLASSES, (e * 7 + u) % 9).alias("endpoint_class"),
        F.when(e % 2 == 0, F.lit("form")).otherwise(F.lit("link")).alias("surface"),
        F.timestamp_micros("us").alias("issued_at"),
        F.timestamp_micros(F.col("us") + 600 * V.MICROS).alias("expires_at"))


def decoy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three hits per capability, some too early, too late or of the wrong kind."""
    e = F.col("event_id")
    hit = F.explode(F.sequence(F.lit(0).cast("long"), e % 3)).alias("j")
    base = events(spark, sf_dir).filter(e % 5 == 0).select("event_id", "us", hit)
    j = F.col("j")
    return base.select(
        F.concat(F.lit("cap-"), e.cast("string")).alias("capability"),
        F.timestamp_micros(F.col("us") + (e % 13 * 60 + j * 45 - F.when(e % 35 == 0, 60).otherwise(0)) * V.MICROS)
        .alias("hit_at"),
        (e * 3 + j).alias("line_no"),
        pick(("rendered", "touched", "submitted", "gazed"), (e + j) % 4).alias("interaction"))


def user_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log lines with addresses and user agents."""
    e = F.col("event_id")
    agents = ("Mozilla/5.0 (compatible; ExampleBot/2.1)", "notexamplebotx/1.0", "PreviewFetch-1 agent",
              "previewfetch (ExampleBot)", "curl/8.0")
    v4 = F.concat_ws(".", pick(("66.249", "66.250", "10.0", "203.0"), e % 4), (e % 3).cast("string"),
                     (e % 251).cast("string"))
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(e % 5)), F.lit("::"), F.lower(F.hex(e % 4093)))
    address = F.when(e % 6 == 5, v6).when(e % 7 == 6, F.concat(F.lit("::ffff:"), v4)).otherwise(v4)
    return events(spark, sf_dir).select(
        e.alias("line_no"), F.timestamp_micros("us").alias("observed_at"),
        pick(agents, e % 5).alias("user_agent"),
        F.when(e % 97 == 0, F.lit("300.1.1.1")).otherwise(address).alias("client_address"),
        (e % 5).cast("int").alias("proto_major"), (e % 3 == 0).alias("tls"),
        F.when(e % 11 == 0, F.lit("nonsense")).when(e % 2 == 0, F.concat(v4, F.lit(":443")))
        .otherwise(v4).alias("remote_address"),
        F.when(e % 8 == 0, F.array(F.lit("198.51.100.7"), F.lit("198.51.100.8")))
        .when(e % 8 == 1, F.array(F.lit("0.0.0.0"))).when(e % 8 == 2, F.array(F.lit("224.0.0.1")))
        .when(e % 8 == 3, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("198.51.100.7"))).alias("forwarded_for"),
        F.when(e % 5 == 0, F.array(F.lit("HTTPS "))).when(e % 5 == 1, F.array(F.lit("http")))
        .when(e % 5 == 2, F.array(F.lit("ftp"))).otherwise(F.array().cast("array<string>"))
        .alias("forwarded_proto"))


def crawler_registry():
    """A small registry; the last two entries overlap on purpose."""
    from ..operators.identity import CrawlerIdentity

    return [
        CrawlerIdentity("search", "search_indexer", ("ExampleBot",), ("66.249.0.0/16", "2001:db8:1::/48")),
        CrawlerIdentity("preview", "preview", ("previewfetch",), ("66.249.0.0/24", "66.250.1.0/24")),
        CrawlerIdentity("preview-b", "preview", ("previewfetch-1", "previewfetch"), ("66.250.0.0/15",)),
    ]


TRUSTED_PROXIES = ["66.249.0.0/16", "66.250.2.0/24"]


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of action proofs: pairs of events share a nonce, some are bad."""
    return proofs_of(events(spark, sf_dir))


def proofs_of(source: DataFrame) -> DataFrame:
    """`proofs` of a batch or stream of events."""
    from ..operators.identity import signature

    e = F.col("event_id")
    nonce = F.concat(F.lit("n-"), div(e, 2).cast("string"))
    issued = F.col("us") - (e % 7) * V.MICROS + F.when(e % 41 == 0, 40 * V.MICROS).otherwise(0)
    df = source.select(
        e.alias("line_no"), nonce.alias("nonce"), issued.alias("issued_us"),
        (issued + F.when(e % 19 == 0, 1).otherwise(60).cast("long") * V.MICROS).alias("expires_us"),
        F.col("us").alias("used_us"), (e % 23 != 0).alias("well_formed"))
    payload = F.concat_ws("|", "nonce", F.col("issued_us").cast("string"), F.col("expires_us").cast("string"))
    df = df.withColumn("payload", payload)
    return df.withColumn("signature", F.when(F.col("line_no") % 17 == 0, F.lit("forged"))
                         .otherwise(signature("payload", LOG_KEY)))


def edge_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed edge signals with forged, old, early, wrong and repeated envelopes; many say nothing."""
    from ..functions.expr import base64url
    from ..operators.identity import edge_signature

    e = F.col("line_no")
    us = micros("observed_at")
    issued = us - (e % 7) * V.MICROS + F.when(e % 41 == 0, 60 * V.MICROS).when(e % 31 == 0, -600 * V.MICROS).otherwise(0)
    df = edge_signals(spark, sf_dir).select(
        "line_no", "edge", F.when(e % 29 == 0, 2).otherwise(1).alias("version"),
        F.when(e % 37 == 0, F.lit("short")).otherwise(base64url(F.unhex(F.md5(div(e, 2).cast("string"))))).alias("nonce"),
        issued.alias("issued_us"), us.alias("used_us"))
    payload = F.concat_ws("|", *[F.col(c).cast("string") for c in ("version", "nonce", "issued_us")], F.to_json("edge"))
    return df.withColumn("payload", payload).withColumn(
        "signature", F.when(e % 17 == 0, F.lit("forged")).otherwise(edge_signature("payload", LOG_KEY)))


def wanted_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoy capabilities that are asked for, each rule broken by some."""
    e, u = F.col("event_id"), F.col("user_id")
    length = F.when(e % 59 == 0, 1).when(e % 61 == 0, 3600).otherwise(60 + e % 200)
    return events(spark, sf_dir).select(
        e.alias("capability"), F.when(e % 43 == 0, F.lit("short")).otherwise(F.concat(F.lit("session-"), u.cast("string"))).alias("session_id"),
        F.when(e % 47 == 0, F.lit("basement")).otherwise(pick(V.ENDPOINT_CLASSES, e % 9)).alias("endpoint_class"),
        F.when(e % 53 == 0, F.lit("banner")).when(e % 97 != 0, pick(("link", "form", "api"), e % 3)).alias("surface"),
        F.timestamp_micros("us").alias("issued_at"), F.timestamp_micros(F.col("us") + length * V.MICROS).alias("expires_at"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of seven versioned documents."""
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        (F.col("user_id") % 7).alias("document"), F.col("us").alias("_us"), e.alias("line_no"),
        (div(e, 20) + e * 13 % 50).alias("revision"), F.concat(F.lit("d"), (e % 3).cast("string")).alias("digest"),
        (e % 19 != 0).alias("valid"))


def trust_tables(spark: SparkSession, sf_dir: str):
    """(credentials, lists, issuers, revoked)."""
    e, u = F.col("event_id"), F.col("user_id")
    ev = events(spark, sf_dir)
    credentials = ev.select(
        e.alias("line_no"), F.col("us").alias("used_us"),
        F.concat(F.lit("issuer-"), (u % 5).cast("string")).alias("issuer_id"),
        F.concat(F.lit("c-"), (e % 97).cast("string")).alias("commitment"))
    lists = ev.filter((e % 500 == 3)).select(
        (div(e, 500) + 1).alias("revision"), F.col("us").alias("installed_us"),
        (F.col("us") + F.when(div(e, 500) % 2 == 0, 600).otherwise(86_400).cast("long") * V.MICROS).alias("expires_us"))
    issuers = lists.select("revision", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "revision", F.concat(F.lit("issuer-"), F.col("k").cast("string")).alias("issuer_id"),
        (F.col("k") % 3).alias("max_level"), F.lit("per_service").alias("scope"), F.lit("login").alias("purpose"))
    revoked = lists.select("revision", F.concat(F.lit("c-"), (F.col("revision") * 7 % 97).cast("string"))
                           .alias("commitment"))
    return credentials, lists, issuers, revoked


def challenges(spark: SparkSession, sf_dir: str):
    """(issued, events) of challenges, one per seventh event."""
    e = F.col("event_id")
    ev = events(spark, sf_dir).filter(e % 7 == 0)
    cid = F.concat(F.lit("ch-"), e.cast("string"))
    issued = ev.select(cid.alias("challenge_id"), (F.col("us") + 2 * V.MICROS).alias("ready_us"),
                       (F.col("us") + 300 * V.MICROS).alias("expires_us"))
    j = F.col("j")
    steps = ev.select("event_id", "us", F.explode(F.sequence(F.lit(0).cast("long"), e % 9)).alias("j"))
    kind = (F.when((e + j) % 11 == 10, F.lit("fallback")).when((e + j) % 3 == 2, F.lit("redeem"))
            .otherwise(F.lit("verify")))
    return issued, steps.select(
        cid.alias("challenge_id"), (F.col("us") + (j * (1 + e % 50) + e % 4) * V.MICROS).alias("us"),
        (e * 10 + j).alias("line_no"), kind.alias("kind"), ((e + j) % 5 == 0).alias("ok"))


def liveness(spark: SparkSession, sf_dir: str):
    """(issued, answers) of liveness attempts of three rounds, one per fourth event."""
    e = F.col("event_id")
    ev = events(spark, sf_dir).filter(e % 4 == 0)
    aid = F.concat(F.lit("at-"), e.cast("string"))
    issued = ev.select(aid.alias("attempt_id"), F.lit(3).alias("rounds"),
                       (F.col("us") + 60 * V.MICROS).alias("expires_us"))
    j = F.col("j")
    steps = ev.select("event_id", "us", F.explode(F.sequence(F.lit(0).cast("long"), e % 5)).alias("j"))
    reveal = F.col("us") + j * 5 * V.MICROS
    return issued, steps.select(
        aid.alias("attempt_id"),
        (reveal + F.when(e % 44 == 0, 100_000).when(e % 52 == 0, 4_900_000).when(e % 68 == 0, 70 * V.MICROS)
         .otherwise(500_000)).alias("us"),
        (e * 10 + j).alias("line_no"), (j + F.when((e % 28 == 0) & (j > 0), 1).otherwise(0)).alias("round"),
        reveal.alias("reveal_us"), (reveal + 4 * V.MICROS).alias("deadline_us"),
        ((e + j) % 13 != 0).alias("correct"))


def edge_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an `edge` struct that partly contradicts the base signals."""
    e = F.col("line_no")
    unknown = F.lit("unknown")
    edge = F.struct(
        F.when(e % 3 == 0, F.lit("passed")).otherwise(unknown).alias("challenge_verdict"),
        F.when(e % 5 == 0, F.lit("anomalous")).otherwise(unknown).alias("edge_fingerprint_class"),
        F.when(e % 5 == 0, F.lit("tls")).otherwise(unknown).alias("edge_fingerprint_method"),
        F.when(e % 7 == 0, F.lit("high_risk")).otherwise(unknown).alias("network_reputation"),
        F.when(e % 11 == 0, F.lit("hosting")).otherwise(unknown).alias("network_type"),
        F.when(e % 4 == 0, 0.25).otherwise(0.0).alias("external_risk_score"),
        (e % 33 == 0).alias("policy_alert"))
    return requests(spark, sf_dir).withColumn("edge", edge)


def rollout_plan():
    """Enforcement of all eligible endpoints that expires before the last events."""
    from ..operators.rollout import RolloutPlan

    return RolloutPlan("enforce-a", "enforce", V.ROLLOUT_ENDPOINTS_SORTED, "block", T0,
                       T0 + 5 * 3600 * V.MICROS, 10_000, throttle_seconds=30, block_seconds=600,
                       predecessor_rollout_id="canary-a")


def canary_plan():
    from ..operators.rollout import RolloutPlan

    return RolloutPlan("canary-a", "canary", ("compare_index", "public_content"), "throttle", T0,
                       T0 + 5 * 3600 * V.MICROS, 1000)


# --- telemetry inputs -----------------------------------------------------------------------

def coverage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative coverage reports of seven sources, with resends, restarts and decreases."""
    e = F.col("event_id")
    # seven sources hold all reports, so they are numbered by rank, and a resend finds the report before it by its number
    df = ranked(events(spark, sf_dir).withColumn("src", F.col("user_id") % 7), ["src"], ["us", "event_id"], few_keys=True)
    df = df.withColumn("rn", F.col("_rank") + 1).drop("_rank")
    ahead = df.filter("rn % 3 = 2").select("src", (F.col("rn") + 1).alias("rn"), F.col("us").alias("before"))
    df = df.join(ahead, ["src", "rn"], "left").withColumn("done", F.when(F.col("rn") % 3 == 0, F.col("before")).otherwise(F.col("us")))
    # Reports 3, 6, 9 ... repeat the report before them.
    k = F.when(F.col("rn") % 3 == 0, F.col("rn") - 1).otherwise(F.col("rn"))
    drop = F.when(e % 29 == 0, 50).otherwise(0)
    df = df.withColumn("k", k)
    # one expression for all classes: the compiler of the JVM took up to 1.3 GB for the code of 45 counters
    names = F.array(*[F.lit(name) for name in V.ENDPOINT_CLASSES])
    bases = F.transform(F.array(*[F.lit(i + 1) for i in range(len(V.ENDPOINT_CLASSES))]),
                        lambda times: F.greatest(F.col("k") * times - drop, F.lit(0)))
    endpoints = F.transform(bases, lambda base, i: F.struct(
        names[i].alias("endpoint_class"), (base * 10 + F.when((e % 41 == 0) & (i == 0), 1).otherwise(0)).alias("protected"),
        (base * 4).alias("evaluated"), (base * 2).alias("bypassed"), base.alias("rejected"),
        (base * 3).alias("granted_retries")))
    started = F.lit(T0) + F.col("src") * 600 * V.MICROS
    # A resend has the completion of the report it repeats; some reports claim a future one.
    done, ahead = F.col("done"), F.when(e % 43 == 0, 120 * V.MICROS).otherwise(0)
    return df.select(
        F.lpad(F.hex(F.col("src")), 32, "a").substr(1, 32).alias("_id"), e.alias("line_no"),
        F.timestamp_micros("us").alias("received_at"),
        F.timestamp_micros(started + F.when(e % 37 == 0, V.MICROS).otherwise(0)).alias("source_started_at"),
        (F.col("k") - F.when(e % 31 == 0, 5).otherwise(0)).alias("sequence"),
        F.timestamp_micros(div(done, V.MICROS) * V.MICROS + ahead).alias("completed_at"),
        endpoints.alias("endpoints")).withColumn("source_id", F.lower("_id")).drop("_id")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin request rows with a disposition, latency and failure class."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        e.alias("line_no"), F.timestamp_micros("us").alias("observed_at"),
        F.concat(F.lit("source-"), (u % 5).cast("string")).alias("source_id"),
        F.when(e % 17 == 0, F.lit("basement")).otherwise(pick(V.ENDPOINT_CLASSES, (e * 7 + u) % 9))
        .alias("endpoint_class"),
        pick(("evaluated", "evaluated", "bypassed", "granted_retry", "rejected", "lost"), e % 6)
        .alias("disposition"),
        (e * 7919 % 10007 + e % 13 * 500).alias("latency_us"),
        F.when(e % 43 == 0, F.lit("timeout")).when(e % 47 == 0, F.lit("status")).alias("failure_class"),
        pick(("proof", "batch", "batch", "recorded", "rejected", "dropped", "ignored"), e % 7).alias("stage"),
        pick(("accepted", "accepted", "rejected", "dropped"), e % 4).alias("result"))
