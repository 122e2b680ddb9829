"""Identity context: assurance, agent provenance, crawlers, transport, single use, trust."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.expr import (base64url, concat_bytes, hmac_sha256, in_or_absent, is_finite, micros,
                              optional_class, present, utf8)
from ..functions.greedy import FEW, greedy_chain
from ..functions.net import address_bits, peer_address, prefix_bits, within
from ..functions.timeline import ROWS_PER_CHUNK, Timeline, before, durable, over_timeline, running, stored
from .detect import obs, verified_public_crawler

# --- fixed values: assurance ---------------------------------------------------------
DISQUALIFYING_CONFIDENCE = 0.60
MAX_LEVEL = 1


def derive_assurance(df: DataFrame, liveness: str = "liveness_verified",
                     max_level: int = MAX_LEVEL) -> DataFrame:
    """assurance_level, assurance_sources, assurance_reasons, assurance_withheld."""
    def has(test) -> Column:
        return F.exists("evidence", test)

    sequence = has(lambda e: (e.code == "BROWSER_SEQUENCE_PRESENT") & (e.direction == -1))
    session = has(lambda e: (e.code == "SERVER_SESSION_VERIFIED") & (e.direction == -1))
    contradicted = has(lambda e: (e.dimension == "automation") & (e.direction == 1)
                       & (e.confidence >= DISQUALIFYING_CONFIDENCE))
    alive = F.coalesce(F.col(liveness), F.lit(False))
    df = df.withColumns({
        "_seq": sequence, "_ses": session, "_con": contradicted,
        "_earned": F.when(contradicted | ~sequence, 0).when(alive, 2).otherwise(1)})
    earned, seq, con = F.col("_earned"), F.col("_seq"), F.col("_con")
    withheld = earned > max_level
    level = F.least(earned, F.lit(max_level))
    text = lambda cond, s: F.when(cond, F.lit(s))
    reasons = F.array_sort(present(
        text(F.col("_ses"), "server_session_verified"),
        text(con, "automation_evidence_contradicts_presence"),
        text(~con & seq, "verified_browser_sequence"),
        text(earned == 2, "interactive_liveness_completed"),
        text(~con & ~seq, "no_verified_interaction_evidence"),
        text(withheld, "level_withheld_pending_measurement")))
    sources = F.array_sort(present(
        text(level >= 1, "behavioral"), text(level >= 2, "challenge")))
    return df.withColumns({
        "assurance_level": level.cast("int"), "assurance_sources": sources,
        "assurance_reasons": reasons, "assurance_withheld": withheld,
    }).drop("_seq", "_ses", "_con", "_earned")


def agent_provenance(df: DataFrame) -> DataFrame:
    """provenance (none / declared / verified_purpose), purpose and provenance_reasons."""
    cls = optional_class("observations.crawler_class")
    known = cls.isin(*[c for c in V.CRAWLER_CLASSES if c != "unknown"])
    bot = F.coalesce(obs("verified_bot"), F.lit(False))
    claimed = bot | known
    verified = verified_public_crawler()
    out_of_scope = (bot & cls.isin(*V.BENEFICIAL_CRAWLERS)
                    & ~F.col("endpoint_class").isin(*V.PUBLIC_CRAWLER_ENDPOINTS))
    return df.withColumns({
        "provenance": F.when(~claimed, F.lit("none")).when(verified, F.lit("verified_purpose"))
        .otherwise(F.lit("declared")),
        "purpose": F.when(claimed & known, cls).otherwise(F.lit("")),
        "provenance_reasons": present(
            F.when(claimed & verified, F.lit("agent_verified_for_declared_purpose")),
            F.when(claimed & ~verified, F.lit("agent_identity_declared_not_verified")),
            F.when(claimed & ~verified & out_of_scope,
                   F.lit("agent_purpose_not_permitted_on_endpoint"))),
    })


# --- crawlers ------------------------------------------------------------------------

@dataclass(frozen=True)
class CrawlerIdentity:
    """One registry entry; the registry as a whole is bounded like a configuration."""

    name: str
    crawler_class: str
    user_agent_tokens: tuple[str, ...]
    cidrs: tuple[str, ...]


MAX_IDENTITIES, MAX_PREFIXES, MAX_TOKENS = 128, 4096, 8


def check_registry(registry: list[CrawlerIdentity]) -> None:
    """Raise on an entry outside the registry contract."""
    visible = re.compile(r"^[\x21-\x7e]+$")
    ok = 1 <= len(registry) <= MAX_IDENTITIES
    for r in registry:
        tokens = [t.strip().lower() for t in r.user_agent_tokens]
        ok &= 1 <= len(r.name) <= 64 and bool(visible.match(r.name))
        ok &= r.crawler_class in V.CRAWLER_CLASSES and r.crawler_class != "unknown"
        ok &= 1 <= len(tokens) <= MAX_TOKENS and len(set(tokens)) == len(tokens)
        ok &= all(5 <= len(t) <= 64 and visible.match(t) for t in tokens) and bool(r.cidrs)
        for c in r.cidrs:
            net = ipaddress.ip_network(c.strip(), strict=True)
            a = net.network_address
            mapped = a.version == 6 and a.ipv4_mapped is not None
            private = a.is_private and (a.version == 4 and any(
                a in ipaddress.ip_network(p) for p in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))
                or a.version == 6 and a in ipaddress.ip_network("fc00::/7"))
            ok &= not (mapped or private or a.is_unspecified or a.is_multicast or a.is_loopback)
    if not ok or sum(len(r.cidrs) for r in registry) > MAX_PREFIXES:
        raise ValueError("invalid crawler registry")


def verify_crawlers(df: DataFrame, registry: list[CrawlerIdentity], expires_us: int | None = None,
                    user_agent: str = "user_agent", address: str = "client_address") -> DataFrame:
    """verified_bot, crawler_class, crawler_verification from address and user agent.

    Both must match the same entry; two matching entries give `unknown`. The registry
    has at most 4096 prefixes, so each prefix length is one small broadcast lookup of
    candidate entries and the request rows are neither shuffled nor multiplied.
    """
    check_registry(registry)
    spark = df.sparkSession
    by_length: dict[tuple[int, int], dict[str, list]] = {}
    for i, r in enumerate(registry):
        tokens = "|".join(re.escape(t.strip().lower()) for t in r.user_agent_tokens)
        pattern = rf"(^|[^a-z0-9_-])({tokens})($|[^a-z0-9_-])"
        for c in sorted(set(r.cidrs)):
            width, head = prefix_bits(c)
            by_length.setdefault((width, len(head)), {}).setdefault(head, []).append(
                (i, r.crawler_class, pattern))
    entry = "array<struct<id:int,class:string,pattern:string>>"
    df = df.withColumn("_bits", address_bits(address))
    found = []
    for k, ((width, length), heads) in enumerate(sorted(by_length.items())):
        table = spark.createDataFrame(list(heads.items()), f"_head{k} string, _found{k} {entry}")
        head = F.when(F.length("_bits") == width, F.substring("_bits", 1, length))
        df = df.join(F.broadcast(table), head == F.col(f"_head{k}"), "left").drop(f"_head{k}")
        found.append(F.coalesce(F.col(f"_found{k}"), F.array().cast(entry)))
    agent = F.lower(user_agent)
    hits = F.array_distinct(F.transform(
        F.filter(F.concat(*found), lambda e: F.regexp_like(agent, e.pattern)),
        lambda e: F.struct(e.id.alias("id"), e["class"].alias("class"))))
    alive = F.lit(True) if expires_us is None else micros("observed_at") < expires_us
    df = df.withColumn("_hits", hits)
    one = F.coalesce((F.size("_hits") == 1) & alive, F.lit(False))
    return df.withColumns({
        "verified_bot": one,
        "crawler_class": F.when(one, F.element_at("_hits", 1)["class"]).otherwise(F.lit("unknown")),
        "crawler_verification": F.when(one, F.lit("ip_ua_registry")).otherwise(F.lit("unknown")),
    }).drop("_bits", "_hits", *[f"_found{k}" for k in range(len(found))])


# --- transport -----------------------------------------------------------------------

def normalise_transport(df: DataFrame, trusted_cidrs: list[str], use_address_header: bool = True,
                        use_proto_header: bool = True) -> DataFrame:
    """transport_protocol, transport_security, client_address_source of request logs.

    Input: proto_major, tls (bool), remote_address, forwarded_for / forwarded_proto
    (arrays of header values). Headers count only when the peer is trusted.
    """
    df = df.withColumn("_peer", address_bits(peer_address("remote_address")))
    known = F.col("_peer").isNotNull()
    df = df.withColumn("_trusted", known & within(F.col("_peer"), trusted_cidrs))
    trusted = F.col("_trusted")
    none = F.array().cast("array<string>")
    forwarded = F.coalesce(F.col("forwarded_for"), none)
    single = F.when(F.size(forwarded) == 1, F.trim(F.try_element_at(forwarded, F.lit(1))))
    df = df.withColumn("_bits", address_bits(single))
    bits = F.col("_bits")
    usable = (bits.isNotNull() & bits.contains("1")  # unspecified is all zero
              & ~(F.startswith(bits, F.lit("1110")) & (F.length(bits) == 32))
              & ~(F.startswith(bits, F.lit("11111111")) & (F.length(bits) == 128)))
    usable = F.coalesce(usable, F.lit(False))
    unknown = F.lit("unknown")
    from_header = (F.when(usable, F.lit("trusted_proxy")).otherwise(F.lit("invalid_trusted_proxy"))
                   if use_address_header else unknown)
    proto = F.coalesce(F.col("forwarded_proto"), none)
    scheme = F.when(F.size(proto) == 1, F.lower(F.trim(F.try_element_at(proto, F.lit(1)))))
    proxied = (F.when(scheme == "https", F.lit("trusted_proxy_tls"))
               .when(scheme == "http", F.lit("plaintext")).otherwise(unknown)
               if use_proto_header else unknown)
    major = F.col("proto_major")
    return df.withColumns({
        "transport_protocol": F.when(major.isin(1, 2, 3), F.concat(F.lit("http"), major.cast("string")))
        .otherwise(unknown),
        "transport_security": F.when(trusted, proxied)
        .when(F.coalesce(F.col("tls"), F.lit(False)), F.lit("direct_tls")).otherwise(F.lit("plaintext")),
        "client_address_source": F.when(trusted, from_header)
        .when(known, F.lit("direct")).otherwise(unknown),
        "client_address_bits": F.when(trusted & usable & F.lit(use_address_header), bits)
        .when(known & ~trusted, F.col("_peer")),
    }).drop("_peer", "_trusted", "_bits")


# --- edge signals ----------------------------------------------------------------------

MERGED = ("challenge_verdict", "edge_fingerprint_class", "edge_fingerprint_method",
          "network_reputation", "network_type")


def valid_edge_signals(c: str) -> Column:
    """Contract of an edge signal struct; an envelope must say something."""
    f = lambda n: F.col(f"{c}.{n}")
    known = lambda n: optional_class(f(n)) != "unknown"
    says = (F.coalesce(f("policy_alert"), F.lit(False)) | (f("external_risk_score") > 0)
            | known("challenge_verdict") | known("edge_fingerprint_class")
            | known("network_reputation") | known("network_type"))
    return F.coalesce(
        is_finite(f("external_risk_score")) & f("external_risk_score").between(0.0, 1.0)
        & in_or_absent(f("challenge_verdict"), V.CHALLENGE_VERDICTS)
        & in_or_absent(f("edge_fingerprint_class"), V.FINGERPRINT_CLASSES)
        & in_or_absent(f("edge_fingerprint_method"), V.FINGERPRINT_METHODS)
        & in_or_absent(f("network_reputation"), V.NETWORK_REPUTATIONS)
        & in_or_absent(f("network_type"), V.NETWORK_TYPES)
        & (known("edge_fingerprint_class") == known("edge_fingerprint_method")) & says,
        F.lit(False))


def merge_signals(df: DataFrame, base: str = "observations", edge: str = "edge") -> DataFrame:
    """Fold the `edge` struct into `base`; `signal_conflict` marks contradictions.

    Unknown fills, equal keeps, two different known values conflict (the base is then
    left as it is); risk takes the maximum and alerts add up.
    """
    conflict, merged = F.lit(False), F.col(base)
    for name in MERGED:
        a, b = optional_class(f"{base}.{name}"), optional_class(f"{edge}.{name}")
        conflict = conflict | ((a != "unknown") & (b != "unknown") & (a != b))
        merged = merged.withField(name, F.when(a == "unknown", b).otherwise(a))
    zero = F.lit(0.0)
    merged = merged.withField("external_risk_score", F.greatest(
        F.coalesce(f"{base}.external_risk_score", zero), F.coalesce(f"{edge}.external_risk_score", zero)))
    merged = merged.withField("policy_alert", F.coalesce(f"{base}.policy_alert", F.lit(False))
                              | F.coalesce(f"{edge}.policy_alert", F.lit(False)))
    df = df.withColumn("signal_conflict", conflict)
    return df.withColumn(base, F.when(F.col("signal_conflict"), F.col(base)).otherwise(merged))


# --- single use ------------------------------------------------------------------------

def signature(payload: Column | str, key: bytes) -> Column:
    """base64url HMAC of a text payload."""
    return base64url(hmac_sha256(key, utf8(payload)))


def edge_signature(payload: Column | str, key: bytes, label: str = "evidentry:edge-signals:v1") -> Column:
    return base64url(hmac_sha256(key, concat_bytes(F.lit(bytearray(label.encode() + b"\0")),
                                                   utf8(payload))))


def proof_fault(well_formed: Column, signed: Column, issued_us: str = "issued_us", expires_us: str = "expires_us",
                used_us: str = "used_us", skew_us: int = 30 * V.MICROS) -> Column:
    """bad_signature, malformed or expired; NULL for a use that only a replay can spoil."""
    early = F.col(issued_us) > F.col(used_us) + skew_us
    late = F.col(expires_us) <= F.col(used_us)
    return (F.when(~F.coalesce(signed, F.lit(False)), F.lit("bad_signature"))
            .when(~F.coalesce(well_formed, F.lit(False)), F.lit("malformed"))
            .when(early | late, F.lit("expired")))


def valid_claims(max_lifetime_us: int = 300 * V.MICROS) -> Column:
    """Claim rules of an action proof: version 1, the session and action it is used for, a nonce
    of 16 bytes in base64url, a lifetime of at most `max_lifetime_us`, and request action and
    endpoint class given together or not at all."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lifetime = F.col("expires_us") - F.col("issued_us")
    return F.coalesce(
        (F.col("version") == 1) & (F.col("session_id") == F.col("expected_session"))
        & (F.col("action") == F.col("expected_action")) & F.col("nonce").rlike("^[A-Za-z0-9_-]{21}[AQgw]$")
        & (lifetime > 0) & (lifetime <= max_lifetime_us)
        & (F.octet_length("session_id").between(8, 128))
        & ((text("request_action") == "") == (text("endpoint_class") == "")), F.lit(False))


def audit_single_use(df: DataFrame, well_formed: Column, signed: Column, nonce: str = "nonce",
                     issued_us: str = "issued_us", expires_us: str = "expires_us",
                     used_us: str = "used_us", line: str = "line_no",
                     skew_us: int = 30 * V.MICROS, for_ever: bool = False, few: int = FEW,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `use`: malformed, bad_signature, expired, replayed or accepted. A use with a NULL nonce is malformed."""
    fault = proof_fault(well_formed & F.col(nonce).isNotNull(), signed, issued_us, expires_us, used_us, skew_us)
    return single_use(df, fault, nonce, expires_us, used_us, line, for_ever, few, rows_per_chunk)


def audit_edge_envelopes(df: DataFrame, key: bytes, edge: str = "edge", max_age_us: int = 30 * V.MICROS, skew_us: int = 5 * V.MICROS,
                         few: int = FEW, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `use` to signed edge envelopes (version, nonce, issued_us, payload, signature, `edge` signals, used_us, line_no).

    In this order: bad_signature; malformed (version 1, a nonce of 16 bytes in base64url, signals within their contract
    that say something); expired (older than `max_age_us` or `skew_us` ahead); replayed while the nonce is taken,
    that is until its age and the skew have passed; accepted.
    """
    signed = F.col("signature") == edge_signature("payload", key)
    formed = ((F.col("version") == 1) & (F.col("issued_us") >= 0) & F.col("nonce").rlike("^[A-Za-z0-9_-]{21}[AQgw]$")
              & valid_edge_signals(edge))
    age = F.col("used_us") - F.col("issued_us")
    fault = (F.when(~F.coalesce(signed, F.lit(False)), F.lit("bad_signature"))
             .when(~F.coalesce(formed, F.lit(False)), F.lit("malformed"))
             .when(~F.coalesce(age.between(-skew_us, max_age_us), F.lit(False)), F.lit("expired")))
    kept = df.withColumn("_until", F.col("issued_us") + max_age_us + skew_us)
    return single_use(kept, fault, "nonce", "_until", "used_us", "line_no", few=few, rows_per_chunk=rows_per_chunk).drop("_until")


def single_use(df: DataFrame, fault: Column, nonce: str, expires_us: str, used_us: str, line: str, for_ever: bool = False,
               few: int = FEW, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `use`: the `fault` of a use where it has one, else replayed or accepted.

    An accepted use takes its nonce until its expiry, or `for_ever`. The first valid use of a
    nonce is found by a map-side combined minimum and marked by an equi-join on (nonce,
    position), so a nonce replayed a billion times neither sorts nor joins in one task. Only
    nonces with valid uses after an expiry need more, a greedy chain: they are folded, and those with more than
    `few` uses go by a jump table that is cut by rank. The uses and their faults are written once: they are read up to
    four times, and a fault checks a signature.
    """
    df = stored(df.withColumn("_state", fault), "uses")
    valid = df.filter("_state IS NULL").select(
        F.col(nonce).alias("nonce"), F.col(used_us).alias("used"), F.col(expires_us).alias("expires"), F.col(line).alias("line"))
    about = valid.groupBy("nonce").agg(F.min(F.struct("used", "line")).alias("f"), F.max("used").alias("latest"),
                                       F.min("expires").alias("soonest"), F.count(F.lit(1)).alias("n"))
    first = about.select("nonce", "f.used", "f.line")
    if not for_ever:
        again = durable(about.filter("latest >= soonest").select("nonce", "n"))
        uses = valid.join(again.select("nonce"), "nonce", "left_semi")
        large = not again.filter(F.col("n") > few).isEmpty()
        taken = greedy_chain(uses, ["nonce"], "used", "expires", "line", few, rows_per_chunk, large)
        first = first.join(again.select("nonce"), "nonce", "left_anti").unionByName(taken)
    first = first.select(F.col("nonce").alias(nonce), F.col("used").alias(used_us), F.col("line").alias(line), F.lit(True).alias("_first"))
    out = df.join(first, [nonce, used_us, line], "left")
    use = F.coalesce(F.col("_state"), F.when(F.col("_first"), F.lit("accepted")), F.lit("replayed"))
    return out.withColumn("use", use).drop("_state", "_first")


# --- versioned documents ---------------------------------------------------------------

def monotone_revisions(df: DataFrame, key: str, order_us: str = "_us", line: str = "line_no",
                       revision: str = "revision", digest: str = "digest", valid: str = "valid",
                       rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add `update`: invalid, unchanged, rollback or installed, and `installed_revision`."""
    def apply(d: DataFrame, lineage: Timeline) -> DataFrame:
        # Among equal revisions the one that came first is the installed one.
        seen = F.when(F.col(valid), F.struct(
            F.col(revision).alias("r"), (-F.col(order_us)).alias("u"), (-F.col(line)).alias("l"),
            F.col(digest).alias("d")))
        return lineage.run(d, {"_cur": before("max", seen)})

    out = over_timeline(df, [key], [order_us, line], apply, rows_per_chunk)
    cur = F.col("_cur")
    ok = F.coalesce(F.col(valid), F.lit(False))
    newer = cur.isNull() | (F.col(revision) > cur.r)
    same = (F.col(revision) == cur.r) & (F.col(digest) == cur.d)
    return out.withColumns({
        "update": F.when(~ok, F.lit("invalid")).when(newer, F.lit("installed"))
        .when(same, F.lit("unchanged")).otherwise(F.lit("rollback")),
        "installed_revision": F.when(ok & newer, F.col(revision)).otherwise(cur.r),
    }).drop("_cur")


def issuer_trust(credentials: DataFrame, lists: DataFrame, issuers: DataFrame, revoked: DataFrame,
                 max_level: int = MAX_LEVEL, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """trusted, maximum_assurance_level, uniqueness_scope and issuer_purpose per credential.

    credentials: used_us, issuer_id, commitment. lists: revision, installed_us,
    expires_us (accepted revisions only). issuers: revision, issuer_id, max_level,
    scope, purpose. revoked: revision, commitment.

    The list in force is the last one installed, until it expires. Lists and uses go on one
    time line, which is cut by rank into chunks of `rows_per_chunk`; every chunk hands its
    last list on to the next. A list and a use of the same instant: the list comes first.
    """
    entry = F.struct("revision", "expires_us")
    left = credentials.withColumns({"_side": F.lit(1), "_list": F.lit(None).cast("struct<revision:long,expires_us:long>")})
    right = lists.select(F.col("installed_us").alias("used_us"), F.lit(0).alias("_side"),
                         entry.cast("struct<revision:long,expires_us:long>").alias("_list"), F.col("revision").alias("line_no"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_all", F.lit(0))

    def apply(d: DataFrame, line: Timeline) -> DataFrame:
        return line.run(d, {"_now": running("last", F.col("_list"))})

    c = over_timeline(both, ["_all"], ["used_us", "_side", "line_no"], apply, rows_per_chunk).filter("_side = 1")
    c = c.withColumn("revision", F.when(F.col("_now.expires_us") > F.col("used_us"), F.col("_now.revision"))).drop(
        "_side", "_list", "_now", "_all")
    c = c.join(issuers, ["revision", "issuer_id"], "left")
    gone = revoked.select("revision", "commitment").distinct().withColumn("_gone", F.lit(True))
    c = c.join(gone, ["revision", "commitment"], "left")
    trusted = F.col("max_level").isNotNull() & F.col("_gone").isNull()
    return c.withColumns({
        "trusted": trusted,
        "maximum_assurance_level": F.when(trusted, F.least(F.col("max_level"), F.lit(max_level)))
        .otherwise(F.lit(0)).cast("int"),
        "uniqueness_scope": F.when(trusted, F.col("scope")),
        "issuer_purpose": F.when(trusted, F.col("purpose")),
    }).drop("max_level", "scope", "purpose", "_gone")
