"""What a task of an ordered stream holds does not grow with the rows of a key."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidentry.plans import catalog, derived as T
from evidentry.streaming import ordered
from evidentry.streaming.operators import Coverage, SingleUse


class Store:
    """The state of one slot; `most` is the largest value that a call has given or taken."""

    def __init__(self):
        self.most, self.timers = 0, set()

    def seen(self, value):
        self.most = max(self.most, sum(len(x) for x in value if isinstance(x, bytes | str)))
        return value

    def getValueState(self, name, schema):
        return Value(self)

    def getMapState(self, name, key, schema):
        return Map(self)

    def getListState(self, name, schema):
        return List(self)

    def registerTimer(self, ms):
        self.timers.add(ms)


class Value:
    def __init__(self, store):
        self.store, self.value = store, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = self.store.seen(value)

    def clear(self):
        self.value = None


class Map:
    def __init__(self, store):
        self.store, self.values = store, {}

    def exists(self):
        return bool(self.values)

    def getValue(self, key):
        found = self.values.get(key)
        return found and self.store.seen(found)

    def updateValue(self, key, value):
        self.values[key] = self.store.seen(value)

    def removeKey(self, key):
        del self.values[key]

    def iterator(self):
        return iter(list(self.values.items()))


class List:
    def __init__(self, store):
        self.store, self.values = store, []

    def exists(self):
        return bool(self.values)

    def appendValue(self, value):
        self.values.append(value)

    def get(self):
        self.store.seen([v[0] for v in self.values])
        return iter(self.values)

    def put(self, values):
        self.values = values

    def clear(self):
        self.values = []


@pytest.fixture
def small(monkeypatch):
    """Runs, pieces and batches so small that a few thousand rows need several levels of merging."""
    for name, value in {"RUN_BYTES": 20_000, "PIECE_BYTES": 4_000, "MERGED_ROWS": 50, "FAN_IN": 3, "BATCH_ROWS": 100}.items():
        monkeypatch.setattr(ordered, name, value, raising=False)


def released(processor, rows, watermarks, columns):
    """Frames of a slot whose rows come in one micro-batch for each watermark, and its store."""
    store, frames = Store(), []
    processor.init(store)
    size = -(-len(rows) // len(watermarks))
    before = 0
    for i, after in enumerate(watermarks):
        came = rows[i * size:(i + 1) * size]
        batches = [pd.DataFrame(came[j:j + 100], columns=columns) for j in range(0, len(came), 100)]
        frames += processor.handleInputRows((0,), iter(batches), SimpleNamespace(getCurrentWatermarkInMs=lambda at=before: at))
        # a processor lives for one micro-batch
        processor.settled_slots = set()
        frames += processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda at=after: at), None)
        before = after
    return frames, store


def folded(processor, rows):
    """The same by one sorted list of each key."""
    out = []
    for key in {r[0] for r in rows}:
        state = None
        for row in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            state = processor._advance(state, row[1], [])
            state, more = processor.step(state, row[1:])
            out += [(key, *m) for m in more]
    return sorted(out, key=repr)


def given(frames, width):
    return sorted((tuple(r) for f in frames for r in f.iloc[:, :width].itertuples(index=False)), key=repr)


def test_one_source_is_released_in_pieces(small):
    rnd = random.Random(1)
    rows = []
    for n in range(4000):
        source, seq = ("a" if n % 4 else None), n // 3
        counters = ",".join(str(seq * 1000 + i - (rnd.random() < 0.1) * 5000) for i in range(36))
        rows.append((source, n // 2 * 1000, n, n % 17 != 0, seq, seq, 0, counters))
    rnd.shuffle(rows)
    columns = ["source_id", *Coverage.fields]
    coverage = Coverage()
    frames, store = released(coverage, rows, [4000], columns)
    assert given(frames, 3) == folded(Coverage(), rows)
    assert store.most < 10_000 < sum(len(r[-1]) for r in rows) / 50
    assert max(map(len, frames)) <= 110
    assert not coverage.buffer.pieces.values and not coverage.buffer.runs()


def test_reports_of_equal_time_and_line_go_by_their_number(small):
    rows = [("a", 5000, 1, True, seq, 0, 0, str(seq)) for seq in range(400, 0, -1)]
    frames, _ = released(Coverage(), rows, [4000], ["source_id", *Coverage.fields])
    assert given(frames, 3) == [("a", 1, "accepted")] * 400


def test_rows_that_wait_stay_in_the_buffer(small):
    """Several micro-batches, each releasing a part of the rows; later batches bring rows behind the ones that wait."""
    rnd = random.Random(2)
    rows = [(f"n{n % 5}", us, n, us + rnd.randrange(1, 300_000))
            for n, us in enumerate(rnd.randrange(3_000_000, 4_000_000) for _ in range(3000))]
    frames, store = released(SingleUse(), rows, [1000, 2000, 3400, 3401, 3700, 5000], ["nonce", *SingleUse.fields])
    late = {r[1] for f in frames for r in f[f["late_line_no"].notna()][["nonce", "late_line_no"]].itertuples(index=False)}
    assert 0 < len(late) < 2000 and len(late) + sum(f["line_no"].notna().sum() for f in frames) == len(rows)
    on_time = [f[f["line_no"].notna()] for f in frames]
    assert given(on_time, 3) == folded(SingleUse(), [r for r in rows if r[2] not in late])
    assert store.most < 10_000
    assert min(store.timers) > 0


def test_derived_reports_compile_to_small_methods(spark, tmp_path):
    """The JVM's compiler takes native memory by the size of a method."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), i % 9, "view", 1.0, "{}") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = T.coverage_reports(spark, str(tmp_path))
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert df.count() == 200
    assert 0 < max(sizes) < 2000


def test_staged_tables_have_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader holds a row group at once."""
    df = spark.range(0, 40_000, 1, 1).select("id", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512).alias(f"c{i}") for i in range(10)])
    monkeypatch.setattr(catalog, "shared_folder", lambda spark, name: str(tmp_path / name))
    assert catalog._staged(spark, df, "staged").isStreaming
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "staged").glob("*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)]
    assert sum(sizes) > 40e6
    assert max(sizes) < 25e6
