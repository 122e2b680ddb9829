"""Keyed state machines that see rows in event-time order.

Rows of a micro-batch arrive unordered. Each key buffers them until the watermark has
passed and then releases them in (time, line_no) order, so a finite stream gives the
rows of the batch operator. Buffers hold what arrived within the watermark delay.

A call of the state store costs more than many rows, so keys are dealt to `SLOTS` slots by hash: a slot
has one buffer of Arrow batches, at most three timers and a map with the state of each of its keys.

A key may hold more rows than a task's memory, so a buffer is a set of sorted runs (`Runs`), cut into pieces. A release
merges the runs and holds a piece of each, and the states of the keys that it meets.

A row that arrives behind the watermark, or without a time, cannot be put in order any more. It comes out at
once, tagged by `late_line_no` and `late_us` with all other outputs NULL, so on-time and late
rows together are all rows (`jobs.write_with_late` parts them).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATE = ("late_line_no", "late_us")
SLOTS = 4096             # part of a checkpoint, like the number of partitions
BATCH_ROWS = 10_000      # most rows of one buffered piece, and of one batch of output
RUN_BYTES = 16 << 20     # of a slot's new rows that are sorted in memory at once
PIECE_BYTES = 256 << 10  # of a run that are read at once
MERGED_ROWS = 1000       # rows of one piece of a run that is made of others
FAN_IN = 32              # runs that are merged at once
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


class Runs:
    """Buffered rows of a slot: runs in order, each cut into pieces that are one value of the state store.

    A run is a list of its number, its next piece, its number of pieces and a time that none of its rows is before. `order`
    begins with the time; rows that are equal in it come out as they came in.
    """

    def __init__(self, handle: StatefulProcessorHandle, schema: pa.Schema, order: tuple[str, ...]) -> None:
        self.schema, self.order = schema, order
        self.places = [schema.names.index(c) for c in order]
        self.pieces = handle.getMapState("pieces", "run long, piece long", "rows binary")
        self.index = handle.getValueState("runs", "text string")

    def runs(self) -> list[list[int]]:
        found = self.index.get()
        return [] if found is None else json.loads(found[0])

    def keep(self, runs: list[list[int]]) -> int | None:
        """Store what is left of the runs; a time that none of their rows is before."""
        left = [run for run in runs if run[1] < run[2]]
        if left:
            self.index.update((json.dumps(left),))
        elif runs:
            self.index.clear()
        return min((run[3] for run in left), default=None)

    def add(self, rows: pa.Table) -> None:
        """Store rows as a new run."""
        runs = self.runs()
        run = self._write(_unused(runs), [rows.sort_by([(c, "ascending") for c in self.order])])
        self.keep([*runs, run])

    def take(self, runs: list[list[int]], settled: int) -> Iterator[tuple]:
        """Rows before `settled`, in order. They leave the store as they are read; `keep` is due after the last one."""
        ready, number = [run for run in runs if run[3] < settled], _unused(runs)
        while len(ready) > FAN_IN:
            fewer = []
            for lo in range(0, len(ready), FAN_IN):
                fewer.append(self._write(number, self._tables(self._merged(ready[lo:lo + FAN_IN], settled))))
                number += 1
            ready = [run for run in fewer if run[2]]
        return self._merged(ready, settled)

    def _merged(self, runs: list[list[int]], settled: int) -> Iterator[tuple]:
        if len(runs) == 1:
            return self._read(runs[0], settled)
        return heapq.merge(*[self._read(run, settled) for run in runs], key=lambda row: [(row[p] is None, row[p]) for p in self.places])

    def _read(self, run: list[int], settled: int) -> Iterator[tuple]:
        while run[1] < run[2]:
            at = (run[0], run[1])
            rows = _unpacked(self.pieces.getValue(at)[0], self.schema)
            n = pc.sum(pc.less(rows["us"], settled)).as_py()
            if n < rows.num_rows:
                run[3] = rows["us"][n].as_py()
                if n:
                    self.pieces.updateValue(at, (_packed(rows.slice(n)),))
                yield from _rows(rows.slice(0, n))
                return
            self.pieces.removeKey(at)
            run[1] += 1
            yield from _rows(rows)

    def _tables(self, rows: Iterator[tuple]) -> Iterator[pa.Table]:
        while some := list(islice(rows, MERGED_ROWS)):
            yield pa.table([pa.array(c, f.type) for c, f in zip(zip(*some), self.schema)], self.schema)

    def _write(self, number: int, tables: Iterable[pa.Table]) -> list[int]:
        first, n = 0, 0
        for table in tables:
            first = first if n else table["us"][0].as_py()
            size = min(BATCH_ROWS, max(1, table.num_rows * PIECE_BYTES // table.nbytes))
            for piece in table.combine_chunks().to_batches(max_chunksize=size):
                self.pieces.updateValue((number, n), (_packed(piece),))
                n += 1
        return [number, 0, n, first]


class OrderedProcessor(StatefulProcessor):
    """Base class. Subclasses fold ordered rows into a state tuple and output tuples."""

    key: str
    fields: tuple[str, ...]          # input columns after the key; first is us, second line_no
    fields_schema: str
    order: tuple[str, ...] = ("us", "line_no")
    state_schema: str
    output: str                      # output schema, key first
    outputs: tuple[str, ...]

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """New state and output rows (without the key) after one input row."""
        raise NotImplementedError

    def deadline_us(self, state: tuple | None) -> int | None:
        """When the state must be looked at again without input."""
        return None

    def expire(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        """New state and output rows once the deadline has passed."""
        return None, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [field.split() for field in self.fields_schema.split(", ")]
        self.arrow = pa.schema([(self.key, pa.string()), *((name, ARROW[kind]) for name, kind in kinds)])
        self.buffer = Runs(handle, self.arrow, self.order)
        self.states = handle.getMapState("states", "name string", self.state_schema)
        self.due = handle.getValueState("due", "us long")  # no state of the slot has an earlier deadline
        self.settled_slots = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, fresh, late = None, [], []
        none = (None,) * (len(self.outputs) - 1)
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            # pandas turns whole numbers into floats where a batch also has a NULL
            batch = pa.Table.from_pandas(pdf[self.arrow.names], self.arrow, preserve_index=False, safe=False)
            on_time = pc.fill_null(pc.greater_equal(batch["us"], settled), False)
            tardy, batch = batch.filter(pc.invert(on_time)), batch.filter(on_time)
            late += [(name, *none, line, us) for name, line, us in _rows(tardy.select([self.key, "line_no", "us"]))]
            if len(late) >= BATCH_ROWS:
                yield self._frame(late)
                late = []
            if batch.num_rows:
                fresh.append(batch)
                low = pc.min(batch["us"]).as_py()
                first = low if first is None else min(first, low)
            if sum(b.nbytes for b in fresh) >= RUN_BYTES:
                self.buffer.add(pa.concat_tables(fresh))
                fresh = []
        if fresh:
            self.buffer.add(pa.concat_tables(fresh))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key[0] in self.settled_slots:  # the first timer of a micro-batch has done all that the watermark allows
            return
        self.settled_slots.add(key[0])
        now_ms = timerValues.getCurrentWatermarkInMs()
        settled = now_ms * 1000
        runs = self.buffer.runs()
        known = self.states.exists()
        due = self.due.get()[0] if self.due.exists() else None
        states: dict[str | None, tuple | None] = {}
        stored = set()
        out: list[tuple] = []
        for row in self.buffer.take(runs, settled):
            name = row[0]
            if name not in states:
                came = self.states.getValue((name,)) if known else None
                states[name] = None if came is None else tuple(came)
                if came is not None:
                    stored.add(name)
            found: list[tuple] = []
            state = self._advance(states[name], row[1], found)
            states[name], more = self.step(state, row[1:])
            out += [(name, *r, None, None) for r in found + more]
            if len(out) >= BATCH_ROWS:
                yield self._frame(out)
                out = []
        first = self.buffer.keep(runs)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        for name, state in states.items():
            found = []
            state = self._advance(state, settled, found)
            due = _least(due, self._keep(name, state, name in stored))
            out += [(name, *r, None, None) for r in found]
            if len(out) >= BATCH_ROWS:
                yield self._frame(out)
                out = []
        if due is not None and due <= settled:
            due, kept = None, [(name[0], tuple(state)) for name, state in self.states.iterator()]
            for name, state in kept:
                found = []
                after = self._advance(state, settled, found)
                due = _least(due, self.deadline_us(after) if after == state else self._keep(name, after, True))
                out += [(name, *r, None, None) for r in found]
        if due is not None:
            self.due.update((due,))
            self.handle.registerTimer(max(-(-due // 1000), now_ms + 1))
        elif self.due.exists():
            self.due.clear()
        if out:
            yield self._frame(out)

    def _advance(self, state: tuple | None, now_us: int, out: list[tuple]) -> tuple | None:
        """The state after a deadline that lies at or before `now_us`."""
        if state is not None:
            deadline = self.deadline_us(state)
            if deadline is not None and deadline <= now_us:
                state, more = self.expire(state)
                out += more
        return state

    def _keep(self, name: str | None, state: tuple | None, had: bool) -> int | None:
        """Store or drop the state of a key; its deadline."""
        if state is not None:
            self.states.updateValue((name,), state)
            return self.deadline_us(state)
        if had:
            self.states.removeKey((name,))
        return None

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.outputs, *LATE], dtype=object)

    def close(self) -> None:
        pass


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in table.columns))


def _packed(rows: pa.Table | pa.RecordBatch) -> bytes:
    """Rows as bytes: the length of their record batch, and that batch compressed."""
    batch = rows if isinstance(rows, pa.RecordBatch) else rows.combine_chunks().to_batches()[0]
    blob = batch.serialize()
    return blob.size.to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def _unpacked(blob: bytes, schema: pa.Schema) -> pa.Table:
    size = int.from_bytes(blob[:8], "little")
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.decompress(bytes(blob[8:]), size, "zstd"), schema)])


def _unused(runs: list[list[int]]) -> int:
    return max((run[0] for run in runs), default=-1) + 1


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def run_ordered(stream: DataFrame, processor: OrderedProcessor, time: str = "event_time",
                delay: str = "10 minutes") -> DataFrame:
    """Apply a processor to a stream that has the key, `us`, `line_no` and an event time.

    The session must use the RocksDB state store; state then lives on disk and is
    checkpointed incrementally. Columns `LATE` are NULL but for rows behind the watermark.
    """
    import evidentry
    from evidentry import streaming

    # the runner of stateful processors sees no files that were shipped: processors travel with their code
    for module in (streaming, evidentry.vocab):
        if module.__name__ not in cloudpickle.list_registry_pickle_by_value():
            cloudpickle.register_pickle_by_value(module)
    columns = list(dict.fromkeys([processor.key, *processor.fields]))
    slot = F.pmod(F.xxhash64(processor.key), F.lit(SLOTS)).cast("int").alias("slot")
    # Spark drops late rows by the event-time column, so it ends here; the watermark itself goes on
    watched = stream.select(*dict.fromkeys([*columns, time])).withWatermark(time, delay).select(slot, *columns)
    output = f"{processor.output}, {', '.join(f'{c} long' for c in LATE)}"
    return watched.groupBy("slot").transformWithStateInPandas(processor, output, "Append", "EventTime")
