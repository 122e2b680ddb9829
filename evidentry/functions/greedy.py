"""Greedy chains: of a key's rows the first one is taken, then always the first that has come far enough.

A row has a time `at` and a time `until`; after it is taken, the next one is the first row, by
(`at`, `line`), with `at >= until`. Used nonces (until their expiry) and window starts (until the
greatest age) are such chains.

* Keys of at most `few` rows are folded in one aggregate: one shuffle and no Python.
* Larger keys get a jump table. The row that would follow a row is the nearest one at or after
  its `until`, a running value on a `Timeline`, so a key is cut by rank into chunks whatever its
  times are. Jumps are composed pairwise (1, 2, 4, ... steps), and from the longest jump down every
  level doubles the rows known to be taken. That are 2 * log2(rows taken) equi-joins on single rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import ROWS_PER_CHUNK, Timeline, durable, over_timeline, running

FEW = 10_000


def greedy_chain(rows: DataFrame, keys: Sequence[str], at: str, until: str, line: str, few: int = FEW,
                 rows_per_chunk: int = ROWS_PER_CHUNK, large: bool | None = None) -> DataFrame:
    """(keys, at, line) of the rows taken. `until` is later than `at`, or NULL where nothing follows.

    (keys, at, line) names a row; `at`, `until` and `line` are integers. `large=False` says that no key has more
    than `few` rows, which saves the count.
    """
    keys = list(keys)
    rows = rows.select(*keys, F.col(at).cast("long").alias("at"), F.col(until).cast("long").alias("until"), F.col(line).cast("long").alias("line"))
    big = None
    if large is not False:
        big = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select(*keys))
        big = None if big.isEmpty() else big
    # at most rows / few keys; whether they are broadcast is left to their measured size
    small = rows if big is None else rows.join(big, keys, "left_anti")
    taken = _folded(small, keys)
    if big is not None:
        taken = taken.unionByName(_jumped(rows.join(big, keys, "left_semi"), keys, rows_per_chunk))
    return taken.select(*keys, F.col("at").alias(at), F.col("line").alias(line))


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<struct<at:bigint,line:bigint>>").alias("taken"))

    def step(acc, x):
        free = (F.size(acc.taken) == 0) | F.coalesce(x.at >= acc.until, F.lit(False))
        more = F.struct(x.until.alias("until"), F.concat(acc.taken, F.array(F.struct(x.at.alias("at"), x.line.alias("line")))).alias("taken"))
        return F.when(free, more).otherwise(acc)

    ordered = F.sort_array(F.collect_list(F.struct("at", "line", "until")))
    folded = F.aggregate(ordered, start, step, lambda acc: acc.taken)
    return rows.groupBy(*keys).agg(folded.alias("_taken")).select(*keys, F.inline("_taken"))


def _jumped(rows: DataFrame, keys: list[str], rows_per_chunk: int) -> DataFrame:
    rows = durable(rows)
    none = F.lit(None).cast("struct<at:bigint,line:bigint>")
    uses = rows.select(*keys, (-F.col("at")).alias("_t"), F.lit(0).alias("_side"), (-F.col("line")).alias("_l"),
                       F.struct("at", "line").alias("_use"), none.alias("_from"))
    asked = rows.where("until IS NOT NULL").select(*keys, (-F.col("until")).alias("_t"), F.lit(1).alias("_side"), (-F.col("line")).alias("_l"),
                                                   none.alias("_use"), F.struct("at", "line").alias("_from"))

    # backwards in time the last use seen is the next one; at the same instant uses come first, the earliest line last
    def following(d: DataFrame, line: Timeline) -> DataFrame:
        return line.run(d, {"_next": running("last", F.col("_use"))})

    met = over_timeline(uses.unionByName(asked), keys, ["_t", "_side", "_l"], following, rows_per_chunk)
    jumps = met.where("_side = 1 AND _next IS NOT NULL").select(
        *keys, F.col("_from.at").alias("at"), F.col("_from.line").alias("line"),
        F.col("_next.at").alias("next_at"), F.col("_next.line").alias("next_line"))
    levels = [durable(jumps)]
    while True:
        on = levels[-1].select(*keys, F.col("at").alias("next_at"), F.col("line").alias("next_line"),
                               F.col("next_at").alias("far_at"), F.col("next_line").alias("far_line"))
        twice = durable(levels[-1].join(on, [*keys, "next_at", "next_line"]).select(
            *keys, "at", "line", F.col("far_at").alias("next_at"), F.col("far_line").alias("next_line")))
        if twice.isEmpty():
            break
        levels.append(twice)
    first = rows.groupBy(*keys).agg(F.min(F.struct("at", "line")).alias("f"))
    taken = first.select(*keys, "f.at", "f.line")
    for level in reversed(levels):
        ahead = taken.join(level, [*keys, "at", "line"]).select(*keys, F.col("next_at").alias("at"), F.col("next_line").alias("line"))
        taken = durable(taken.unionByName(ahead))
    return taken
