"""Ordered per-key computations that survive hot keys.

A plain window function hands one key to one task. When a single key holds a
large share of all rows that task never ends, so every ordered operator of this
package runs on a `Timeline`:

* cold keys use a plain window, partitioned by the key;
* rows of hot keys (more than `rows_per_chunk` rows, found by one pre-aggregated
  count) are ranked and cut into consecutive chunks of exactly that size, whatever their
  times are. Each chunk is computed on its own and then corrected by the *carry*: the running state of the chunks
  before it, one small row per chunk.

`sum`, `max`, `min`, `bit_or`, `last` and `first` states can be merged, which makes
both ways give identical rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 20_000_000
MIN_ROWS_PER_CHUNK = 100_000


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage into the cluster's shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        import tempfile

        shared = tempfile.mkdtemp(prefix="evidentry-checkpoint-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it: unlike a checkpoint, its
    readers take only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Partitioned writes inside keep a file open for each of up to `most` partitions of a task; only rows of further ones are sorted.

    The sort that Spark puts before such a write otherwise holds a task's whole share as rows; an open Parquet file
    holds one encoded row group.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    found = spark.conf.get(name)
    spark.conf.set(name, str(max(most, int(found))))
    try:
        yield
    finally:
        spark.conf.set(name, found)


@dataclass(frozen=True)
class Running:
    """A running value over the rows before (and, if `inclusive`, at) the current row."""

    kind: str
    expr: Column
    inclusive: bool = True


def running(kind: str, expr: Column) -> Running:
    return Running(kind, expr, True)


def before(kind: str, expr: Column) -> Running:
    return Running(kind, expr, False)


_WINDOW_AGG = {
    "sum": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _merge(kind: str, earlier: Column, later: Column) -> Column:
    if kind == "sum":
        both = earlier + later
    elif kind == "max":
        return F.greatest(earlier, later)
    elif kind == "min":
        return F.least(earlier, later)
    elif kind == "bit_or":
        both = earlier.bitwiseOR(later)
    elif kind == "last":
        return F.coalesce(later, earlier)
    elif kind == "first":
        return F.coalesce(earlier, later)
    else:
        raise ValueError(kind)
    return F.coalesce(both, earlier, later)


@dataclass(frozen=True)
class Timeline:
    """Rows ordered by `order` within `keys`; `chunk` is set for hot rows only."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str | None = None

    def _window(self, segment: Sequence[str]):
        extra = (self.chunk,) if self.chunk else ()
        return Window.partitionBy(*self.keys, *extra, *segment).orderBy(*self.order)

    def run(self, df: DataFrame, specs: dict[str, Running], segment: str | None = None) -> DataFrame:
        """Add running columns. `segment` must not decrease along the order."""
        if self.chunk:
            df = durable(df)
        seg = (segment,) if segment else ()
        window = self._window(seg)
        local = {
            name: _WINDOW_AGG[s.kind](s.expr).over(
                window.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1))
            for name, s in specs.items()
        }
        out = df.withColumns(local)
        if self.chunk is None:
            return out
        carry = self._carry(df, specs, segment)
        out = out.join(F.broadcast(carry), [*self.keys, self.chunk], "left")
        here = F.col(segment).eqNullSafe(F.col("_carry_segment")) if segment else F.lit(True)
        merged = {
            name: F.when(here & F.col("_carry").isNotNull(),
                         _merge(s.kind, F.col(f"_carry.{name}"), F.col(name))).otherwise(F.col(name))
            for name, s in specs.items()
        }
        return out.withColumns(merged).drop("_carry", "_carry_segment")

    def _carry(self, df: DataFrame, specs: dict[str, Running], segment: str | None) -> DataFrame:
        """One row per chunk: state of the chunk's first segment before the chunk."""
        seg = F.col(segment) if segment else F.lit(0)
        at = F.struct(*self.order)

        def total(s: Running) -> Column:
            if s.kind in ("last", "first"):
                edge = F.max if s.kind == "last" else F.min
                seen = F.when(s.expr.isNotNull(), F.struct(at.alias("at"), s.expr.alias("v")))
                return edge(seen).getField("v")
            return _WINDOW_AGG[s.kind](s.expr)

        per_segment = df.groupBy(*self.keys, self.chunk, seg.alias("_seg")).agg(
            *[total(s).alias(name) for name, s in specs.items()])
        state = F.struct(*specs)
        tails = per_segment.groupBy(*self.keys, self.chunk).agg(
            F.min("_seg").alias("_first"), F.max("_seg").alias("_last"),
            F.max_by(state, "_seg").alias("_tail"))
        upto = (Window.partitionBy(*self.keys, "_last").orderBy(self.chunk)
                .rowsBetween(Window.unboundedPreceding, 0))
        states = tails.select(
            *self.keys, self.chunk, "_first", "_last",
            F.struct(*[_WINDOW_AGG[s.kind](F.col(f"_tail.{name}")).over(upto).alias(name)
                       for name, s in specs.items()]).alias("_state"))
        prior = Window.partitionBy(*self.keys).orderBy(self.chunk)
        return states.select(
            *self.keys, self.chunk, F.col("_first").alias("_carry_segment"),
            F.when(F.lag("_last").over(prior).eqNullSafe(F.col("_first")),
                   F.lag("_state").over(prior)).alias("_carry"))


@dataclass(frozen=True)
class Heat:
    """Hot keys of a frame, and how many rows a chunk of them has at most."""

    keys: DataFrame
    rows_per_chunk: int


def find_heat(df: DataFrame, keys: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> Heat | None:
    """Hot keys, or None when no key exceeds `rows_per_chunk`.

    There are at most rows / rows_per_chunk hot keys; `rows_per_chunk` is raised to
    `MIN_ROWS_PER_CHUNK` on a cluster, so their broadcast stays small.
    """
    return find_sizes(df, keys, None, rows_per_chunk)[1]


def find_sizes(df: DataFrame, keys: Sequence[str], few: int | None, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[bool, Heat | None]:
    """Whether a key has more than `few` rows, and the hot keys, by one pre-aggregated count."""
    if df.isStreaming:
        return False, None
    if not df.sparkSession.sparkContext.master.startswith("local"):
        rows_per_chunk = max(rows_per_chunk, MIN_ROWS_PER_CHUNK)
    least = rows_per_chunk if few is None else min(few, rows_per_chunk)
    sizes = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least))
    if sizes.isEmpty():
        return False, None
    hot = sizes.filter(F.col("_n") > rows_per_chunk).select(*keys)
    return True, None if hot.isEmpty() else Heat(hot, rows_per_chunk)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], few_keys: bool = False) -> DataFrame:
    """Add `_rank`: the number of rows of the same key before a row, from 0 on.

    Rows are dealt by range of (keys, order), so a key spans tasks and neither a burst nor
    equal times meet in one; a row number decides between rows that are equal in both. The
    counts per key and task (one small row each) turn places within a task into ranks. With `few_keys` (thousands, not
    millions) they are broadcast, and the rows are not shuffled again.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(tasks, *keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie")
        .drop("_tie").withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_task", F.shiftright("_place", 33))
    counts = placed.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    upto = Window.partitionBy(*keys).orderBy("_task")
    ahead = counts.select(*keys, "_task", "_first", (F.sum("_n").over(upto) - F.col("_n")).alias("_ahead"))
    return placed.join(F.broadcast(ahead) if few_keys else ahead, [*keys, "_task"]).withColumn(
        "_rank", F.col("_ahead") + F.col("_place") - F.col("_first")).drop("_task", "_place", "_first", "_ahead")


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int) -> DataFrame:
    """Add `_chunk`: the rank of a row within its key, divided by `rows_per_chunk`. `keys` are hot, so they are few."""
    return ranked(df, keys, order, few_keys=True).withColumn(
        "_chunk", F.floor(F.col("_rank") / F.lit(float(rows_per_chunk))).cast("long")).drop("_rank")


def over_timeline(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  apply: Callable[[DataFrame, Timeline], DataFrame],
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Run `apply` over cold keys with plain windows and over hot keys in chunks."""
    return with_heat(df, keys, order, apply, find_heat(df, tuple(keys), rows_per_chunk))


def with_heat(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              apply: Callable[[DataFrame, Timeline], DataFrame], heat: Heat | None) -> DataFrame:
    """`over_timeline` with hot keys that were found before."""
    keys, order = tuple(keys), tuple(order)
    if heat is None:
        return apply(df, Timeline(keys, order))
    cold = df.join(F.broadcast(heat.keys), list(keys), "left_anti")
    hot = chunked(df.join(F.broadcast(heat.keys), list(keys), "left_semi"), keys, order, heat.rows_per_chunk)
    return apply(cold, Timeline(keys, order)).unionByName(
        apply(hot, Timeline(keys, order, "_chunk")).drop("_chunk"))
