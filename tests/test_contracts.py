"""Contracts, sources and sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidentry.operators import contracts, pseudonym
from evidentry.plans import derived as T
from evidentry.sources import jsonl, reports, sealed, shards

GOOD = {
    "schema_version": contracts.LOCAL_INPUT_VERSION, "observed_at": "2024-01-01T00:00:00Z",
    "subject_ref": "s", "source": "access_gateway", "endpoint_class": "api", "action_class": "read",
    "status_class": "success",
    "evidence": {"collection_status": "complete", "automation_evidence": "none",
                 "abuse_intent_evidence": "low", "continuity_evidence": "high",
                 "decoy_interaction": "none", "challenge_lifecycle": "none"},
    "label": {"class": "unknown", "provenance": "none", "confidence": "unknown"}}


def line(**changes):
    return json.dumps({**GOOD, **changes})


def test_strict_jsonl(spark, tmp_path):
    text = line()
    bad = {
        "": "blank_line",
        text + " x": "invalid_json",
        text[:-1]: "invalid_json",
        text[:-1] + ', "source": "access_gateway"}': "duplicate_key",
        line(extra=1): "unknown_field",
        line(evidence={**GOOD["evidence"], "extra": "x"}): "unknown_field",
        line(subject_ref=7): "wrong_type",
        "[1]": "wrong_type",
        line(subject_ref=" padded"): "reference",
        line(subject_ref="x\u0001"): "reference",
        line(subject_ref="y" * 513): "reference",
        line(source="spreadsheet"): "closed_enum",
        line(label={"class": "unknown", "provenance": "none", "confidence": "confirmed"}): "label_pairing",
        line(observed_at="2024-01-01T00:00:00+00:00"): "observed_at",
        line(observed_at="2024-13-01T00:00:00Z"): "observed_at",
    }
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([text, *bad, line(session_ref="session")]) + "\n")
    valid, quarantine = jsonl.read_evidence_jsonl(spark, str(path))
    assert valid.count() == 2
    got = [r.reason for r in quarantine.orderBy("source_split", "line_no").collect()]
    assert sorted(got) == sorted(bad.values())


def test_chronology_across_blocks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([1, 2, 2, 5, 4, 6, 6, 3])], "line long, t long")
    df = df.withColumn("at", F.timestamp_micros(F.col("t") * 1_000_000))
    for block in (1, 2, 3, 100):
        late = contracts.check_chronology(df, "at", "line", block=block).orderBy("line").collect()
        assert [(r.line, r.previous_us // 1_000_000) for r in late] == [(4, 5), (7, 6)]


def test_budget_fails_closed(spark, sf):
    summary = contracts.source_summary(T.requests(spark, sf), "observed_at", kind=None)
    budget = contracts.scan_budget(summary, max_records=10)
    assert budget.first().ok is False
    with pytest.raises(Exception, match="scan budget exceeded: records"):
        contracts.enforce_budget(budget).collect()


def test_log_split(spark, sf):
    from evidentry.operators.decide import decide

    from evidentry.functions.timeline import durable

    records = durable(T.log_records(decide(T.requests(spark, sf))))
    decisions, outcomes, bad = contracts.decode_log_records(records)
    total = records.count()
    assert decisions.count() + outcomes.count() + bad.count() == total and bad.count() > 0


def test_retention_bounds(spark, sf):
    with pytest.raises(ValueError):
        contracts.apply_retention(T.requests(spark, sf), F.current_timestamp(), 91)


def test_publish_and_verify(spark, sf, tmp_path):
    path = str(tmp_path / "published")
    df = T.local_events(spark, sf)
    manifest = shards.publish_evidence(df, path, shard_size=100)
    total = shards.published_summary(manifest).first()
    assert total.events == df.count() and total.shards >= 10
    assert manifest.filter("records > 100").count() == 0
    bounds = manifest.orderBy("first_us").collect()
    assert all(a.last_us <= b.first_us for a, b in zip(bounds, bounds[1:]))
    assert shards.verify_published(spark, path).count() == 0
    with pytest.raises(Exception):
        shards.publish_evidence(df, path, shard_size=100)
    df.limit(1).write.mode("append").parquet(f"{path}/{shards.DATA}")
    assert [r.problem for r in shards.verify_published(spark, path).collect()] == ["undeclared"]
    found = shards.read_manifest(spark, path)
    changed = found.withColumn("sha256", F.when(F.col("file") == bounds[0].file, F.lit("0" * 64))
                               .otherwise(F.col("sha256")))
    assert [r.problem for r in shards.compare_shards(changed, found).collect()] == ["hash"]
    assert [r.problem for r in shards.compare_shards(found, found.filter(
        F.col("file") != bounds[0].file)).collect()] == ["missing"]


def test_sealed_records(spark):
    df = spark.range(20).select(F.lit("log-a").alias("source"), F.col("id").alias("seq"),
                                F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))
    box = sealed.encrypt_records(df, b"k" * 32)
    box.cache()
    rows, bad = sealed.decrypt_records(box, b"k" * 32, "name string")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect())) and bad.count() == 0
    assert sealed.decrypt_records(box, b"x" * 32, "name string")[0].count() == 0
    moved = box.withColumn("seq", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq")))
    assert sealed.decrypt_records(moved, b"k" * 32, "name string")[1].count() == 2
    assert sealed.check_counters(box).first().contiguous is True
    assert sealed.check_counters(box.filter("seq <> 7")).first().contiguous is False
    assert box.select("sealed").distinct().count() == 20


def test_reports(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    reports.publish_report(one, str(tmp_path / "a"))
    with pytest.raises(Exception):
        reports.publish_report(two, str(tmp_path / "a"))
    for df in (one, two):
        reports.publish_report(df, str(tmp_path / "b"), replace=True)
    assert reports.read_latest_report(spark, str(tmp_path / "b")).count() == 2


def test_pseudonyms(spark):
    import base64
    import hashlib
    import hmac
    import struct

    df = spark.createDataFrame([("alice", None, "2024-01-01 10:00:00"), ("alice", None, "2024-01-01 23:59:59"),
                                ("alice", None, "2024-01-02 00:00:00"), ("älice", "s1", "2024-01-01 10:00:00")],
                               "subject_ref string, session_ref string, t string")
    df = df.withColumn("observed_at", F.col("t").cast("timestamp"))
    got = pseudonym.pseudonymise(df, b"k" * 32, "d", "p").orderBy("t", "session_id").collect()
    by_time = {(r.t, r.session_id is not None): r for r in got}
    a, b = by_time[("2024-01-01 10:00:00", False)], by_time[("2024-01-01 23:59:59", False)]
    c, d = by_time[("2024-01-02 00:00:00", False)], by_time[("2024-01-01 10:00:00", True)]
    assert a.subject_id == b.subject_id != c.subject_id and d.session_id not in (None, d.subject_id)
    other = pseudonym.pseudonymise(df, b"k" * 32, "d", "q").filter("session_id is null").first()
    assert other.subject_id not in (a.subject_id, c.subject_id)

    def field(x):
        return struct.pack(">Q", len(x.encode())) + x.encode()
    day = hmac.new(pseudonym.domain_key(b"k" * 32, "d", "p"), field(pseudonym.DAY_LABEL) + field("2024-01-01"),
                   hashlib.sha256).digest()
    want = hmac.new(day, field("session") + field("älice") + field("s1"), hashlib.sha256).digest()
    assert d.session_id == base64.urlsafe_b64encode(want).decode().rstrip("=")
    with pytest.raises(ValueError):
        pseudonym.assert_no_direct_refs(df)


def test_long_ids_stay_apart(spark):
    users = spark.createDataFrame([(123456780,), (123456789,), (7,), (10**12,)], "user long")
    ids = [r[0] for r in users.select(T._session(F.col("user"))).collect()]
    assert ids == ["session-123456780", "session-123456789", "session-00000007", "session-1000000000000"]


def test_budget_reports_and_enforces(spark):
    summary = spark.createDataFrame([(2_000_000, 1, 1)], "records long, files long, bytes long")
    budget = contracts.scan_budget(summary, max_records=1_000_000)
    assert budget.first()["ok"] is False
    with pytest.raises(Exception, match="scan budget exceeded"):
        contracts.enforce_budget(budget).collect()


def test_days_far_apart_and_missing(spark):
    rows = [(1, "a", "s", 0), (2, "a", "s", 4_000 * 365 * 86_400), (3, "a", None, None), (4, "a", "s", 1)]
    df = spark.createDataFrame(rows, "line_no int, subject_ref string, session_ref string, t long").select(
        "line_no", "subject_ref", "session_ref", F.timestamp_seconds("t").alias("observed_at"))
    out = {r["line_no"]: r for r in pseudonym.pseudonymise(df, b"k" * 32, "d", "p").collect()}
    assert set(out) == {1, 2, 3, 4} and out[3]["subject_id"] is None
    assert out[1]["subject_id"] == out[4]["subject_id"] != out[2]["subject_id"]
    kept, bad = pseudonym.without_day(df)
    assert kept.count() == 3 and [r["reason"] for r in bad.collect()] == ["time"]


def test_long_line_keeps_its_text(spark, tmp_path):
    from evidentry.sources import jsonl

    line = '{"source":"' + "x" * (1 << 20) + '"}'
    (tmp_path / "a.jsonl").write_text(f"{line}\n\nnot json\n")
    _, bad = jsonl.read_evidence_jsonl(spark, str(tmp_path))
    got = {r["reason"]: r["value"] for r in bad.collect()}
    assert got == {"line_too_long": line, "blank_line": "", "invalid_json": "not json"}


def test_other_versions_and_labels(spark, tmp_path):
    """Records of another producer are read under its own version strings."""
    (tmp_path / "b.jsonl").write_text(line(schema_version="other.local.v1") + "\n")
    assert jsonl.read_evidence_jsonl(spark, str(tmp_path))[0].count() == 0
    assert jsonl.read_evidence_jsonl(spark, str(tmp_path), "other.local.v1")[0].count() == 1
    from evidentry.operators import holdout

    ids = spark.createDataFrame([("v9", "subject", "A" * 42 + "B", "family"), ("v9", "subject", "A" * 43, "\u2003x")],
                                "schema_version string, sequence_kind string, sequence_id string, family_ref string")
    good, bad = holdout.load_families(ids, holdout.family_reason("v9"))
    assert good.count() == 1 and [r["reason"] for r in bad.collect()] == ["family_ref"]
    other, _ = holdout.load_families(ids, holdout.family_reason("v9"), b"x\0", b"y\0")
    assert other.first()["family_digest"] != good.first()["family_digest"]


def test_absent_reason_codes_are_an_empty_list(spark):
    from evidentry.operators import decide

    records = T.log_records(decide.decide(T.requests(spark, "/root/testdata/sf0.001"))).filter("kind = 'decision' AND decision IS NOT NULL")
    absent = records.withColumn("decision", F.col("decision").withField("reason_codes", F.lit(None).cast("array<string>")))
    reasons = {r[0] for r in absent.select(contracts.log_reason()).collect()}
    assert None in reasons and "reason_code" not in reasons
    versions = ("a", "b", "c", "d")
    renamed = records.withColumn("schema_version", F.translate(F.substring("schema_version", -1, 1), "1234", "abcd"))
    count = lambda df, *a: df.select(contracts.log_reason(*a).alias("r")).filter("r IS NULL").count()
    assert count(renamed, 1, versions) == count(records) > 0 == count(renamed)


def test_import_and_verification(spark, tmp_path):
    from evidentry.sources import importer

    rows = [line(observed_at=f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", subject_ref=f"s{i % 7}") for i in range(300)]
    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder, lines in ((good, rows), (bad, rows[:50] + rows[10:12] + ["{}"])):
        folder.mkdir()
        (folder / "a.jsonl").write_text("\n".join(lines) + "\n")
    args = (b"k" * 32, "d", "p")
    with pytest.raises(importer.ImportRefused, match="break the contract"):
        importer.import_evidence(spark, str(bad), str(tmp_path / "x"), *args)
    with pytest.raises(importer.ImportRefused, match="older"):
        importer.import_evidence(spark, str(bad), str(tmp_path / "x"), *args, max_quarantined=1)
    assert not (tmp_path / "x").exists()
    record = importer.import_evidence(spark, str(bad), str(tmp_path / "x"), *args, max_quarantined=1, max_out_of_order=1).first()
    assert record["events"] == 52 and record["warnings"] == ["quarantined:schema_version", "out_of_order"]

    target = tmp_path / "y"
    record = importer.import_evidence(spark, str(good), str(target), *args, shard_size=100).first()
    assert (record["events"], record["quarantined"], record["warnings"]) == (300, 0, [])
    stored_rows = spark.read.parquet(f"{target}/shards")
    assert stored_rows.count() == 300 and "subject_ref" not in stored_rows.columns
    assert importer.verify_import(spark, str(target)).count() == 0
    (target / "shards" / "notes.txt").write_text("x")
    shard = sorted((target / "shards").glob("*.parquet"))[0]
    shard.write_bytes(sorted((target / "shards").glob("*.parquet"))[1].read_bytes())
    (shard.parent / f".{shard.name}.crc").unlink(missing_ok=True)
    found = {(r["problem"]) for r in importer.verify_import(spark, str(target)).collect()}
    assert "undeclared" in found and found & {"size", "hash"}
    with pytest.raises(Exception):
        importer.import_evidence(spark, str(good), str(target), *args)      # never overwrites


def test_lines_are_parsed_once(spark, tmp_path):
    """Valid records and quarantine read what one check has written; neither runs it again."""
    from evidentry.sources import jsonl

    (tmp_path / "c.jsonl").write_text("\n".join([line(), line() + " x", "", line(source="spreadsheet")]) + "\n")
    valid, bad = jsonl.read_evidence_jsonl(spark, str(tmp_path))
    for found in (valid, bad):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert valid.count() == 1 and {(r.reason, r.value) for r in bad.where("reason <> 'closed_enum'").collect()} == {
        ("invalid_json", line() + " x"), ("blank_line", "")}
    assert bad.count() == 3


def test_review_of_a_proposal_scores_the_log_once(spark, sf, monkeypatch):
    """Gates and proposal share the log and the links."""
    from evidentry.plans import catalog

    names, write = [], catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda df, name: names.append(name) or write(df, name))
    for stage in (catalog.d8_proposal_canary, catalog.d8_proposal_enforce):
        stage(spark, sf)
    assert sorted(names) == ["links", "links", "log", "log"]


def test_uses_are_checked_once(spark, sf):
    """The audit of envelopes reads what one check of the signatures has written."""
    from evidentry.operators import identity
    from evidentry.plans import derived as T

    out = identity.audit_edge_envelopes(T.edge_envelopes(spark, sf), T.LOG_KEY).select("line_no", "use")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "_state" in plan
    assert out.count() == T.edge_envelopes(spark, sf).count()
