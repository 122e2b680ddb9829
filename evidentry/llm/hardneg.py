"""Hard-negative mining by Fagin's threshold algorithm over blocks of vectors.

Vectors are dealt by range of (dimension, label, id) into blocks of at most `BLOCK_ROWS` rows, so
a hot label is cut by id and a block has few labels. A block has one list of its rows for every
dimension, sorted by that component. An anchor reads all lists at once, from the high end where
its component is positive and from the low end where it is negative (sorted access), and scores
every row it meets by its integer inner product (random access). No row that it has not met
scores above the threshold, the sum of the anchor's components times the values read last. It
stops when the threshold lies strictly below the k-th score of each of its windows, or below the
windows themselves; ties are therefore never lost.

The best of each block meet by a grouped rank. Anchors travel as packs, a block's anchors in one
row, and stream through the blocks that they are dealt to; a task holds one block at a time.
Nothing is sampled, and every anchor meets every block that may hold an answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

BLOCK_ROWS = 4096
FIRST_DEPTH = 32      # entries read of every list at first; then twice as many
EXACT = 2**53         # float64 sums below it are exact; larger ones are computed in Python integers

_BLOCK = "block long, size int, labels array<long>, ids binary, label binary, marks binary, vectors binary"


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    marks: np.ndarray
    vectors: np.ndarray    # rows of integers


def _packed(ids: list[int], labels: list[int], marks: list[bool], vectors: list[list[int]], size: int) -> dict:
    flat = np.array(vectors, np.int64).reshape(len(ids), size)
    return {"size": size, "labels": sorted(set(labels)), "ids": np.array(ids, np.int64).tobytes(), "label": np.array(labels, np.int64).tobytes(),
            "marks": np.array(marks, np.uint8).tobytes(), "vectors": flat.tobytes()}


def _unpacked(row: dict) -> Block:
    ids = np.frombuffer(row["ids"], np.int64)
    return Block(ids, np.frombuffer(row["label"], np.int64), np.frombuffer(row["marks"], np.uint8).astype(bool),
                 np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["size"]))


def _pack(rows_per_block: int):
    """Sorted rows of a task to blocks; of rows with the same dimension, label and id the first stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        last = None

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            made = {"block": number, **_packed([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], [r[3] for r in held], last[0])}
            held, number = [], number + 1
            return pa.RecordBatch.from_pylist([made], schema=_BLOCK_ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024).to_pydict()
                for size, label, id_, mark, vector in zip(*(part[c] for c in ("size", "label", "id", "mark", "vector")), strict=True):
                    if last == (size, label, id_):
                        continue
                    if held and (len(held) == rows_per_block or last[0] != size):
                        yield flush()
                    last = (size, label, id_)
                    held.append((id_, label, mark, vector))
        if held:
            yield flush()
    return run


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("labels", pa.list_(pa.int64())), ("ids", pa.binary()),
                          ("label", pa.binary()), ("marks", pa.binary()), ("vectors", pa.binary())])


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs: the marked rows of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            b = _unpacked(row)
            at = np.flatnonzero(b.marks)
            if len(at):
                made = _packed(b.ids[at].tolist(), b.labels[at].tolist(), [True] * len(at), b.vectors[at].tolist(), row["size"])
                yield pa.RecordBatch.from_pylist([{"block": row["block"], **made}], schema=_BLOCK_ARROW)


class Lists:
    """The sorted lists of one block."""

    def __init__(self, block: Block):
        self.block = block
        self.order = np.argsort(block.vectors, axis=0, kind="stable").T.astype(np.int32)     # ascending, one row per dimension
        self.sorted = np.take_along_axis(block.vectors, self.order.T.astype(np.int64), axis=0).T
        self.most = max(abs(int(block.vectors.min())), abs(int(block.vectors.max()))) if block.vectors.size else 0
        self.exact = block.vectors.astype(np.float64)

    def search(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least score, greatest score; None: unbounded) the first k wanted rows, (score, row), best first."""
        n = len(self.block.ids)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        if not n or not wanted.any():
            return best
        most = max((abs(int(x)) for x in anchor), default=0)
        small = most * self.most * max(1, len(anchor)) < EXACT
        rows, a = (self.exact, anchor.astype(np.float64)) if small else (self.block.vectors.astype(object), anchor.astype(object))
        lists = np.flatnonzero(anchor != 0)
        high = lists[anchor[lists] > 0]
        low = lists[anchor[lists] < 0]
        values = self.sorted if small else self.sorted.astype(object)
        seen = np.zeros(n, bool)
        depth, read = 0, FIRST_DEPTH
        while True:
            # the threshold before reading further: what rows not met so far can reach
            if depth < n and len(lists):
                at = max(0, depth - 1)
                limit = int((a[high] * values[high, n - 1 - at]).sum()) + int((a[low] * values[low, at]).sum())
            else:
                limit = 0 if not depth else None
            done = limit is None or all(
                (len(b) >= k and b[-1][0] > limit) or (lo is not None and lo > limit) for b, (lo, _) in zip(best, windows, strict=True))
            if done:
                return best
            end = min(n, depth + read) if len(lists) else n
            if len(lists):
                met = np.zeros(n, bool)
                met[self.order[high, n - end:n - depth].ravel()] = True
                met[self.order[low, depth:end].ravel()] = True
                fresh = np.flatnonzero(met & ~seen)
                seen |= met
            else:
                fresh = np.arange(n)
            depth, read = end, read * 2
            fresh = fresh[wanted[fresh]]
            score = (rows[fresh] @ a).astype(np.int64) if small else np.array([int(s) for s in rows[fresh] @ a], object)
            for w, (lo, hi) in enumerate(windows):
                inside = np.ones(len(fresh), bool)
                if lo is not None:
                    inside &= score >= lo
                if hi is not None:
                    inside &= score <= hi
                if len(best[w]) >= k:
                    inside &= score >= best[w][-1][0]
                at = np.flatnonzero(inside)
                if len(at) > 4 * k:                # only the best scores can be among the first k
                    at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                found = [(int(score[i]), int(fresh[i])) for i in at]
                best[w] = sorted(best[w] + found, key=lambda f: (-f[0], self.block.ids[f[1]]))[:k]


def _stream(schema: pa.Schema, answer):
    """Rows come block by block, the block first and then the packs dealt to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["pack"] is None:
                    at, lists = row["block"], Lists(_unpacked(row))
                elif row["block"] == at:
                    out = answer(lists, row, _unpacked(row))
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def _positives(k: int):
    def answer(lists: Lists, row: dict, pack: Block) -> list[dict]:
        out = []
        for i in range(len(pack.ids)):
            wanted = (lists.block.labels == pack.labels[i]) & (lists.block.ids != pack.ids[i])
            for score, at in lists.search(pack.vectors[i], wanted, [(None, None)], k)[0]:
                out.append({"pack": row["pack"], "place": i, "anchor_id": int(pack.ids[i]), "positive_id": int(lists.block.ids[at]), "positive_score": score})
        return out
    return answer


def _negatives(k: int):
    def answer(lists: Lists, row: dict, pack: Block) -> list[dict]:
        out = []
        asked: dict[int, list[dict]] = {}
        for w in row["windows"]:
            asked.setdefault(w["place"], []).append(w)
        for i, windows in asked.items():
            found = lists.search(pack.vectors[i], lists.block.labels != pack.labels[i], [(w["low"], w["high"]) for w in windows], k)
            for w, rows in zip(windows, found, strict=True):
                out += [{"pack": row["pack"], "place": i, "anchor_id": int(pack.ids[i]), "positive_id": w["positive_id"],
                         "positive_score": w["positive_score"], "negative_id": int(lists.block.ids[at]), "negative_score": score} for score, at in rows]
        return out
    return answer


_FOUND = "pack long, place int, anchor_id long, positive_id long, positive_score long"
_WINDOW = "array<struct<place:int,positive_id:long,positive_score:long,low:long,high:long>>"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _through(blocks: DataFrame, packs: DataFrame, ddl: str, answer) -> DataFrame:
    """Send `packs` (with `to`, the block each row is dealt to) through the blocks."""
    none = F.lit(None)
    data = ("size", "ids", "label", "marks", "vectors")
    home = blocks.select("block", *data, none.cast("long").alias("pack"), none.cast(_WINDOW).alias("windows"))
    guests = packs.select(F.col("to").alias("block"), *data, F.col("block").alias("pack"), "windows")
    dealt = home.union(guests).repartition(partitions(blocks.sparkSession), "block").sortWithinPartitions(
        "block", F.col("pack").asc_nulls_first())
    return dealt.mapInArrow(_stream(_arrow(ddl), answer), ddl)


def hard_negatives(vectors: DataFrame, anchor: Column, id: str = "id", label: str = "label", vector: str = "vector",
                   positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
                   rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of another
    label with low_percent * positive_score <= 100 * score <= high_percent * positive_score.

    `vector` is an array of integers, `label` an integer; scores are inner products, higher ones first, ties by smaller
    id. Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Rows with a null
    id, label, vector or component take no part. Rows of other dimensions never meet. Of rows with the same id, label and
    dimension one stays, that with the least vector. Anchors without positives, and positives without negatives, give
    no rows. Scores must fit into 63 bits, else the job fails. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("mark"),
        F.col(f"`{vector}`").cast("array<long>").alias("vector")).where(
        "id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = rows.withColumn("size", F.size("vector"))
    tasks = max(1, min(partitions(spark), -(-rows.count() // rows_per_block)))
    sorted_rows = rows.repartitionByRange(tasks, "size", "label", "id").sortWithinPartitions(
        "size", "label", "id", "vector", F.desc("mark")).coalesce(tasks)     # blocks are filled, however many partitions there are
    blocks = stored(sorted_rows.mapInArrow(_pack(rows_per_block), _BLOCK), "blocks")
    packs = stored(blocks.mapInArrow(_anchors_of, _BLOCK), "packs")

    # positives: packs go to the blocks that share a label
    home = blocks.select(F.col("block").alias("to"), "size", F.explode("labels").alias("l"))
    away = packs.select("block", "size", F.explode("labels").alias("l"))
    pairs = away.join(home, ["size", "l"]).select("block", "to").distinct()
    dealt = packs.join(pairs, "block").withColumn("windows", F.lit(None).cast(_WINDOW))
    best = Window.partitionBy("pack", "place").orderBy(F.desc("positive_score"), "positive_id")
    found = _through(blocks, dealt, _FOUND, _positives(positives))
    found = stored(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).drop("n"), "positives")

    # negatives: every pack that has windows goes to every block of its dimension; 100 * score as integers
    score = F.col("positive_score").cast("decimal(20,0)")
    low = F.ceil(score * F.lit(low_percent) / F.lit(100)).cast("long")
    high = F.floor(score * F.lit(high_percent) / F.lit(100)).cast("long")
    windows = (found.withColumns({"low": low, "high": high}).where("low <= high").groupBy("pack")
        .agg(F.collect_list(F.struct("place", "positive_id", "positive_score", "low", "high")).alias("windows")))
    asking = packs.join(windows, packs["block"] == windows["pack"]).drop("pack")
    # the blocks of a task are numbered one after another: one row for each task and dimension
    spans = blocks.groupBy(F.shiftright("block", 33).alias("task"), "size").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    dealt = asking.join(F.broadcast(spans.drop("task")), "size").withColumn("to", F.explode(F.sequence("first", "last"))).drop("first", "last")
    ddl = _FOUND + ", negative_id long, negative_score long"
    order = Window.partitionBy("pack", "place", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = _through(blocks, dealt, ddl, _negatives(negatives)).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
