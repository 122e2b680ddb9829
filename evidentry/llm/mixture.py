"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is taken target / source size times on average. The whole part is
fixed; the fractional parts are rounded jointly: two documents meet, words move at random
from one to the other until one of them is a whole copy or none, and the other meets the
next. Expectations hold and the words taken stay the same, so a source misses its target by
at most one document. Rows fight within small groups of their source, the survivors of all
groups fight again, and so on up a reduction tree, so no source needs a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
GROUP_ROWS = 256        # rows of one group of the reduction tree


def ranked(table: DataFrame, key: str, name: str) -> DataFrame:
    """Add `name`: position of the row in ascending order of `key` (null last), from zero.

    The rows are dealt by range and numbered within their range; the counts of the ranges
    (one small row per task) are added up on the driver.
    """
    spark = table.sparkSession
    order = F.col(key).asc_nulls_last()
    rows = stored(table.repartitionByRange(partitions(spark), order).sortWithinPartitions(order)
                  .withColumn("at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    counts = rows.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()
    spark_offsets, total = [], 0
    for c in counts:
        spark_offsets.append((c["range"], total))
        total += c["n"]
    offsets = spark.createDataFrame(spark_offsets or [(-1, 0)], "range long, before long")
    position = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "range").withColumn(name, position).drop("at", "range", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Targets of `sizes(source, size)`: (source, source_size, target).

    Sources in code-point order (null last) take the weights in turn. `share` of all sizes is
    dealt by weight; a target stops at `most` times its source's size and the excess is dealt
    again by weight until none is above. Every round fixes at least one more source, and a
    round is one aggregate over the sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    table = ranked(by, "source", "rank")
    table = stored(table.select("source", "source_size", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")), "targets")
    limit = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = limit <= F.col("weight") * level
        state = table.agg(F.count_if(full).alias("n"), F.sum(F.when(full, limit)).alias("fixed"),
                          F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if state["n"] == capped or not state["open"]:
            break
        capped = state["n"]
        level = (share * total - (state["fixed"] or 0.0)) / state["open"]
    if total and not state["open"]:
        level = float("inf")
    target = F.least(limit, F.col("weight") * F.lit(level)) if total else F.lit(0.0)
    return table.select("source", "source_size", target.cast("double").alias("target"))


def pivotal(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round `share` (in [0, 1]) jointly; returns the rounded shares and the place of the survivor.

    All shares but at most one become 0 or 1, and sum(size * share) is kept. Survivor: -1 if none.
    """
    share = share.astype(np.float64).copy()
    eps, holder = 1e-9, -1
    for k in range(len(share)):
        x = share[k]
        if x <= eps or x >= 1 - eps:
            share[k] = float(x > 0.5)
            continue
        if holder < 0:
            holder = k
            continue
        a, b = holder, k
        sa, sb, xa, xb = float(size[a]), float(size[b]), share[a], share[b]
        up, down = min((1 - xa) * sa, xb * sb), min(xa * sa, (1 - xb) * sb)   # words into a, words out of a
        move = up if draw[k] * (up + down) < down else -down
        xa, xb = xa + move / sa, xb - move / sb
        share[a], share[b] = xa, xb
        if eps < xa < 1 - eps:
            share[b], holder = float(xb > 0.5), a
        else:
            share[a] = float(xa > 0.5)
            if eps < xb < 1 - eps:
                holder = b
            else:
                share[b], holder = float(xb > 0.5), -1
    return share, holder


def _rounded(group: pa.Table) -> pa.Table:
    group = group.sort_by([("size", "descending"), ("h", "ascending"), ("id", "ascending")])   # small survivors
    draw = (group["h"].to_numpy().view(np.uint64) >> np.uint64(11)) * 2.0**-53
    share, holder = pivotal(group["size"].to_numpy(), group["share"].to_numpy(), draw)
    done = np.ones(group.num_rows, bool)
    if holder >= 0:
        done[holder] = False
    at = group.schema.get_field_index("share")
    return group.set_column(at, "share", pa.array(share)).append_column("done", pa.array(done))


def _seeded(seed: int, *columns):
    return F.xxhash64(F.lit(seed), *columns)


def mixed(rows: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
          most: float = MOST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`rows(id, source, size)` with source_size, target and copies (whole copies to take).

    Documents without words and sources whose target is nothing are taken zero times. Reruns
    agree: every draw is a hash of the seed, the level of the tree, the id and the size, so
    ties and repeated rows give the same multiset of results.
    """
    spark = rows.sparkSession
    rows = stored(rows.select("id", "source", "size"), "sizes")
    targets = source_targets(rows, weights, share, most)
    per_source = rows.where("size > 0").groupBy("source").agg(F.count("*").alias("n"))
    plan = stored(targets.join(per_source, targets["source"].eqNullSafe(per_source["source"]), "left")
                  .select(targets["source"].alias("s"), "source_size", "target", F.coalesce("n", F.lit(0)).alias("n")), "plan")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.when(F.col("size") > 0, ratio).otherwise(0.0)
    base = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "size", "source_size", "target", "n", wanted.alias("wanted"))
    base = base.select("*", F.floor("wanted").cast("double").alias("whole"))
    base = base.select("*", (F.col("wanted") - F.col("whole")).alias("share"))
    live = base.where("share > 0")
    out = base.where("share <= 0").select("id", "source", "size", "source_size", "target", F.col("whole").cast("long").alias("copies"))
    level, groups = 0, F.ceil(F.col("n") / group_rows)
    fields = "id long, source string, size long, source_size long, target double, n long, whole double, share double, h long, g long"
    columns = [f.split()[0] for f in fields.split(", ")]
    while True:
        h = _seeded(seed + level, "id", "size")
        live = live.withColumn("h", h).withColumn("g", F.pmod(_seeded(seed - 1 - level, "id", "size"), groups).cast("long"))
        played = stored(live.select(*columns).repartition(partitions(spark), "source", "g").groupBy("source", "g").applyInArrow(
            _rounded, fields + ", done boolean"), "rounded")
        last = played.agg(F.max("n")).first()[0]
        out = out.union(played.where("done").select("id", "source", "size", "source_size", "target",
                                                    (F.col("whole") + F.col("share")).cast("long").alias("copies")))
        live = played.where("not done").drop("done", "h", "g")
        if last is None or last <= group_rows:
            break
        live = live.withColumn("n", F.ceil(F.col("n") / group_rows).cast("long"))
        level += 1
    # one survivor at most per source: its last fraction is drawn on its own
    chance = F.shiftrightunsigned(_seeded(seed + 1_000_003, "id", "size"), 11) * F.lit(2.0**-53)
    return out.union(live.select("id", "source", "size", "source_size", "target", (
        F.col("whole") + F.when(chance < F.col("share"), 1).otherwise(0)).cast("long").alias("copies")))


def mix_report(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (words, repeats counted).

    Null texts count no words; a null source is a source of its own. Repeated rows are
    separate documents. An empty table gives no rows.
    """
    rows = documents.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{source}`").cast("string").alias("source"),
                            words_of(F.col(f"`{text}`")).alias("size"))
    return mixed(rows, **options).select(
        F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mix(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """`documents` repeated as often as the mix takes them.

    Columns stay; `copy` counts the copies of a row from 1, and `mix_size`, `mix_source_size`
    and `mix_target` hold the words of the text, of its source and of its source's target.
    Rows of no copies are left out. Rows that repeat in all of id, text and source are taken
    as often as all of them together. Columns that are already called like the new ones are replaced.
    """
    names = [c for c in documents.columns if c not in ("copy", "mix_size", "mix_source_size", "mix_target")]
    key = F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`"))
    wanted = F.col(f"`{source}`").cast("string")
    rows = documents.select(key.alias("id"), wanted.alias("source"), words_of(F.col(f"`{text}`")).alias("size"))
    taken = mixed(rows, **options).groupBy("id", "source", "size", "source_size", "target").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    taken = stored(taken.select(*[F.col(c).alias(f"mix {c}") for c in ("id", "source", "size", "source_size", "target", "copies", "n")]), "taken")
    found = documents.withColumn("mix key", key).join(
        taken, (F.col("`mix key`") == F.col("`mix id`")) & wanted.eqNullSafe(F.col("`mix source`")))
    once = found.where("`mix n` = 1")
    repeated = found.where("`mix n` > 1").dropDuplicates(["mix id", "mix source"])
    return once.union(repeated).select(
        *[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("`mix copies`"))).alias("copy"),
        F.col("`mix size`").alias("mix_size"), F.col("`mix source_size`").alias("mix_source_size"), F.col("`mix target`").alias("mix_target"))
