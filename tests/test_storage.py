"""The import's refusals, and the table by day."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from evidentry.operators import contracts, decide
from evidentry.plans import derived as T
from evidentry.sources import importer, retention


@pytest.fixture(scope="module")
def lines(spark, sf, tmp_path_factory):
    rough = T.rough_local_events(spark, sf)
    folder = str(tmp_path_factory.mktemp("lines") / "rough")
    rough.coalesce(1).sortWithinPartitions("line_no").select(
        F.to_json(F.struct(*[c for c in rough.columns if c != "line_no"])).alias("value")).write.text(folder)
    return folder


@pytest.mark.parametrize("budget,said", [
    ({}, "break the contract"), ({"max_quarantined": 10**9}, "older than the line before"),
    ({"max_quarantined": 10**9, "max_out_of_order": 10**9, "max_by_reason": {"reference": 3}}, "reference")])
def test_refused_import_leaves_no_folder(spark, lines, tmp_path, budget, said):
    target = str(tmp_path / "out")
    with pytest.raises(importer.ImportRefused, match=said):
        importer.import_evidence(spark, lines, target, b"k" * 32, "dataset-a", "pilot-a", **budget)
    assert not os.path.exists(target)


def test_tolerated_faults_are_recorded(spark, lines, tmp_path):
    target = str(tmp_path / "out")
    record = importer.import_evidence(spark, lines, target, b"k" * 32, "dataset-a", "pilot-a", max_quarantined=10**9, max_out_of_order=10**9,
                                      max_by_reason={"reference": 10**9}).first()
    assert record.quarantined == sum(r.n for r in record.reasons) > 0 and record.out_of_order > 0
    assert record.warnings == [f"quarantined:{r.reason}" for r in record.reasons] + ["out_of_order"]
    assert importer.verify_import(spark, target).count() == 0


def test_table_by_day(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(500).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 7_200).alias("recorded_at"))
    rows = rows.union(spark.createDataFrame([(1000, None)], "id long, recorded_at timestamp"))
    retention.write_dated(rows, path)
    retention.write_dated(rows.where("id < 40"), path)                  # a retry of some days
    read = lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    last = rows.where("id < 40").agg(F.to_date(F.max("recorded_at"))).first()[0]
    dropped = {r.id for r in rows.where((F.to_date("recorded_at") == F.lit(last)) & (F.col("id") >= 40)).collect()}
    assert read() == [i for i in [*range(500), 1000] if i not in dropped]
    now = "2023-12-20 12:00:00"
    kept = retention.read_retained(spark, path, now, keep_days=3)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day" not in kept.columns
    expected = sorted(r.id for r in contracts.apply_retention(rows, F.lit(now).cast("timestamp"), 3).collect())
    assert sorted(r.id for r in kept.collect()) == expected != []
    gone = retention.drop_expired(spark, path, now, keep_days=3)
    assert gone and gone == sorted(gone) and max(gone) < "2023-12-17"
    assert retention.drop_expired(spark, path, now, keep_days=3) == []
    assert sorted(r.id for r in retention.read_retained(spark, path, now, keep_days=3).collect()) == expected and 1000 in read()
    with pytest.raises(ValueError):
        retention.drop_expired(spark, path, now, keep_days=91)


OPEN = "spark.sql.maxConcurrentOutputFileWriters"


@pytest.fixture
def writes(monkeypatch):
    """How many files each write to Parquet may keep open; with none, Spark sorts all rows of a task by partition."""
    seen, parquet = [], DataFrameWriter.parquet

    def watched(writer, *args, **more):
        seen.append(int(writer._spark.conf.get(OPEN)))
        return parquet(writer, *args, **more)
    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    return seen


def test_days_are_written_without_a_sort(spark, tmp_path, writes):
    """One task, more days than open files: the rows are whole, days stay apart, and the session is as it was."""
    path, found = str(tmp_path / "table"), spark.conf.get(OPEN)
    rows = spark.range(0, 3000, 1, 1).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") % 40 * 86_400).alias("recorded_at"))
    retention.write_dated(rows, path)
    assert writes and min(writes) >= 1 and spark.conf.get(OPEN) == found
    table = spark.read.parquet(path)
    assert sorted(r.id for r in table.collect()) == list(range(3000))
    assert table.where(F.to_date("recorded_at") != F.col("day")).isEmpty() and table.select("day").distinct().count() == 40


def test_log_kinds_are_written_without_a_sort(spark, sf, tmp_path, writes):
    found = spark.conf.get(OPEN)
    records = T.log_records(decide.decide(T.requests(spark, sf)))
    split = contracts.split_log_records(records, str(tmp_path / "kinds"))
    assert writes == [3] and spark.conf.get(OPEN) == found
    for mine, plain in zip(split, contracts.decode_log_records(records), strict=True):
        got = sorted(map(repr, mine.select(*plain.columns).collect()))
        assert got and got == sorted(map(repr, plain.collect()))
