"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most `BUDGET` = 4 of 64 bits are linked. The bits are read
from three starting points (0, 21, 42), one trie each. Four differing bits spread over three
leading blocks leave a block with at most one, so each trie only follows node pairs whose
leading block differs by at most one bit, and the union of the three finds every link.

The upper levels of the trie are walked in Spark: every fingerprint goes to the node pairs
it can belong to, and node pairs with too many leaves are expanded by further bits until
each fits a task. Below that a task walks both subtrees together, adds up differing bits
and drops a node pair once its budget is exceeded, or once all its leaves are known to be
connected: components need a spanning set of links, not all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE, SEED, BUDGET = 4, 42, 4
STARTS, BLOCK = (0, 21, 42), 21          # the third block has 22 bits; 21 of them are led by it
LEAVES_PER_NODE = 400                    # aim of the first cut
LEAVES_PER_TASK = 5_000                  # node pairs above it are expanded further
STEP = 4
PAIRS_PER_STEP = 200_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no words."""
    if not text:
        return 0
    words = text.encode().translate(_LOWER).split()   # bytes.split() cuts at exactly the word separators
    if not words:
        return 0
    hashes = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 8192):
        hi = min(n, lo + 8192)
        part = np.fromiter((hashes(b" ".join(words[k:k + SHINGLE]), SEED) for k in range(lo, hi)), np.uint64, hi - lo)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            values = np.fromiter((fingerprint(texts[i].as_py()) for i in range(batch.num_rows)),
                                 np.uint64, batch.num_rows)
            out = {f: batch.column(f) for f in batch.schema.names if f != column}
            out[name] = pa.array(values.view(np.int64))
            yield pa.RecordBatch.from_pydict(out)
    return run


def _pair_key(level: int, prefix: Column, xor: Column) -> Column:
    """Prefix of the smaller of the two nodes prefix and prefix ^ xor, unsigned order for level < 64."""
    return F.least(prefix, prefix.bitwiseXOR(xor))


def _allowed(level: int, xor: Column) -> Column:
    """Whether node pairs of this level with these differing bits can still hold a link."""
    lead = xor if level <= BLOCK else F.shiftrightunsigned(xor, level - BLOCK)
    return (F.bit_count(lead) <= 1) & (F.bit_count(xor) <= BUDGET)


def _patterns(bits: int) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in range(1 << bits) if bin(x).count("1") <= BUDGET])


def _prefix(level: int, fp: Column) -> Column:
    return fp if level >= 64 else F.shiftrightunsigned(fp, 64 - level)


def _expand(nodes: DataFrame, level: int, step: int) -> DataFrame:
    """Deal the leaves of node pairs at `level` to the node pairs `step` bits below."""
    xor = F.shiftleft("xor", step).bitwiseOR(F.col("more"))
    deeper = nodes.select("start", "fp", "xor", F.explode(_patterns(step)).alias("more")).select("start", "fp", xor.alias("xor"))
    return deeper.where(_allowed(level + step, F.col("xor"))).select(
        "start", "fp", "xor", _pair_key(level + step, _prefix(level + step, F.col("fp")), F.col("xor")).alias("node"))


class _Forest:
    """Union-find over leaf numbers, with roots compressed for array look-ups."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge pairs; positions of those that joined two trees."""
        kept, root = [], self.root
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append(k)
        if kept:
            while True:
                again = root[root]
                if np.array_equal(again, root):
                    break
                root = again
            self.root = root
        return np.array(kept, np.int64)


def walk(left: np.ndarray, right: np.ndarray | None, level: int, spent: int) -> np.ndarray:
    """Spanning links between leaves below a node pair: an array of (leaf, leaf).

    left, right: sorted distinct uint64 leaves of two nodes at `level` that differ in `spent`
    bits so far (right None: a node with itself).
    """
    leaves = left if right is None else np.concatenate([left, right])
    n, forest, links = len(left), _Forest(len(leaves)), []
    z = np.zeros(1, np.int64)
    if right is None:
        stack = [(level, z, z + n, z, z + n, z + spent)]
    else:
        stack = [(level, z, z + n, z + n, z + len(leaves), z + spent)]
    while stack:
        depth, alo, ahi, blo, bhi, cost = stack.pop()
        if len(alo) > PAIRS_PER_STEP:
            for k in range(0, len(alo), PAIRS_PER_STEP):
                stack.append((depth, *(x[k:k + PAIRS_PER_STEP] for x in (alo, ahi, blo, bhi, cost))))
            continue
        root = forest.root
        changes = np.cumsum(np.r_[0, root[1:] != root[:-1]])
        open_ = ~((changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (root[alo] == root[blo]))
        alo, ahi, blo, bhi, cost = (x[open_] for x in (alo, ahi, blo, bhi, cost))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(leaves[a] ^ leaves[b]) <= BUDGET
            a, b = a[near], b[near]
            kept = forest.join(a, b)
            links.append(np.stack([leaves[a[kept]], leaves[b[kept]]], axis=1))
            alo, ahi, blo, bhi, cost = (x[~single] for x in (alo, ahi, blo, bhi, cost))
        if not len(alo) or depth >= 64:
            continue
        bit = np.uint64(63 - depth)
        ones = np.concatenate([[0], np.cumsum((leaves >> bit) & np.uint64(1))]).astype(np.int64)
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = (alo == blo) & (ahi == bhi)
        children = []
        for (xl, xh), (yl, yh), differ in (((alo, amid), (blo, bmid), 0), ((amid, ahi), (bmid, bhi), 0),
                                           ((alo, amid), (bmid, bhi), 1), ((amid, ahi), (blo, bmid), 1)):
            keep = (xl < xh) & (yl < yh) & (cost + differ <= BUDGET)
            if differ and xl is amid:
                keep &= ~same                     # the mirror image of a node with itself
            if depth < BLOCK:
                keep &= cost + differ <= 1
            children.append((xl[keep], xh[keep], yl[keep], yh[keep], cost[keep] + differ))
        near = [np.concatenate(x) for x in zip(*children[:2], strict=True)]
        far = [np.concatenate(x) for x in zip(*children[2:], strict=True)]
        for group in (far, near):                 # equal branches first: they connect what the others can skip
            if len(group[0]):
                stack.append((depth + 1, *group))
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


def _node_links(leaves: np.ndarray, start: int, level: int, xor: int, node: int) -> np.ndarray:
    """Links below one node pair, as signed fingerprints in their original bit order."""
    leaves = np.unique(leaves.view(np.uint64))
    if xor == 0:
        links = walk(leaves, None, level, 0)
    else:
        mine = (leaves >> np.uint64(64 - level)).view(np.int64) == node
        links = walk(leaves[mine], leaves[~mine], level, bin(xor).count("1"))
    s = np.uint64(start)
    if start:
        links = (links >> s) | (links << (np.uint64(64) - s))
    return np.ascontiguousarray(links).view(np.int64)


def _walk_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves = batch.column("leaves")
        rows = zip(*(batch.column(c).to_pylist() for c in ("start", "level", "xor", "node")), strict=True)
        found = [_node_links(leaves[i].values.to_numpy(), *row) for i, row in enumerate(rows)]
        links = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_pydict({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def trie_links(fingerprints: DataFrame, leaves_per_task: int = LEAVES_PER_TASK) -> DataFrame:
    """Spanning links (a, b) between the distinct non-null values of `fingerprints(fp)`.

    Two fingerprints are connected through these links exactly if they are connected through
    pairs that differ in at most `BUDGET` bits.
    """
    distinct = stored(fingerprints.select("fp").where("fp is not null").distinct(), "fingerprints")
    n = distinct.count()
    level = min(BLOCK, max(2, math.ceil(math.log2(max(1, n) / LEAVES_PER_NODE))))
    rotated = [F.struct(F.lit(s).alias("start"), (F.col("fp") if s == 0 else F.shiftleft("fp", s).bitwiseOR(
        F.shiftrightunsigned("fp", 64 - s))).alias("fp")) for s in STARTS]
    leaves = distinct.select(F.explode(F.array(*rotated)).alias("x")).select("x.*")
    one_bit = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(level)])
    nodes = leaves.select("start", "fp", F.explode(one_bit).alias("xor")).select(
        "start", "fp", "xor", _pair_key(level, _prefix(level, F.col("fp")), F.col("xor")).alias("node"))
    ready = None
    key = ["start", "xor", "node"]
    while True:
        sizes = nodes.groupBy(*key).agg(F.count("*").alias("n"))
        hot = stored(sizes.where(F.col("n") > leaves_per_task).select(*key), "hot-nodes")
        crowded = level < 60 and not hot.isEmpty()
        cold = nodes.join(hot, key, "left_anti") if crowded else nodes
        cold = cold.withColumn("level", F.lit(level))
        ready = cold if ready is None else ready.unionByName(cold)
        if not crowded:
            break
        step = min(STEP, 60 - level)
        # written once, or every further round would start from the leaves again
        nodes = stored(_expand(nodes.join(hot, key, "left_semi"), level, step), "expanded-nodes")
        level += step
    # one row for each node pair, of at most `leaves_per_task` leaves; pairs with an empty side hold no link
    left = F.expr("shiftrightunsigned(fp, 64 - level)") == F.col("node")
    pairs = ready.groupBy("start", "level", "xor", "node").agg(
        F.collect_list("fp").alias("leaves"), F.count_if(left).alias("left"))
    pairs = pairs.where("IF(xor = 0, size(leaves) > 1, left > 0 AND left < size(leaves))")
    return pairs.select("start", "level", "xor", "node", "leaves").mapInArrow(_walk_nodes, "a long, b long")


def _prints(documents: DataFrame, id: str, text: str) -> DataFrame:
    source = documents.select(F.col(f"`{id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"),
                              F.col(f"`{text}`").alias("text"))
    return stored(source.mapInArrow(_fingerprints("text", "fp"), "id long, text_key long, fp long"), "doc-fingerprints")


def simhash_groups(documents: DataFrame, id: str = "doc_id", text: str = "text",
                   leaves_per_task: int = LEAVES_PER_TASK) -> DataFrame:
    """One row per document: id, fp (signed 64 bits), fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable through links. Null and empty texts have the
    fingerprint zero and link like any other. Rows with a null id join components but never
    name them unless all ids of a component are null. Repeated rows give repeated results;
    an empty table gives none. Copies share a fingerprint, so they meet as one leaf of the trie.
    """
    prints = _prints(documents, id, text)
    labels = components(trie_links(prints, leaves_per_task))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    linked = nodes.join(labels, F.col("fp") == F.col("node")).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id")
    alone = nodes.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = stored(linked.union(alone), "named-fingerprints")
    return prints.join(named, "fp").select(
        F.col("id").alias(id), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_distinct(documents: DataFrame, id: str = "doc_id", text: str = "text",
                     leaves_per_task: int = LEAVES_PER_TASK) -> DataFrame:
    """`documents` with one row of each group: that of the smallest id (null last), then of the smallest text hash.

    Columns stay as they are. Rows that repeat in id and text are copies, so one of them stays.
    """
    prints = _prints(documents, id, text)
    labels = components(trie_links(prints, leaves_per_task))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    firsts = prints.groupBy("fp").agg(F.min(rank).alias("best"))
    linked = firsts.join(labels, F.col("fp") == F.col("node"))
    best = linked.groupBy("component").agg(F.min("best").alias("best")).select("best").union(
        firsts.join(labels, F.col("fp") == F.col("node"), "left_anti").select("best"))
    # how many rows are that very document: nearly always one
    rows = prints.groupBy("id", "text_key").agg(F.count("*").alias("n"))
    stay = best.select(F.col("best.id").alias("i"), F.col("best.text_key").alias("k")).join(
        rows, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("text_key"))).select(
        F.col("i").alias("keep id"), F.col("k").alias("keep key"), F.col("n").alias("keep rows"))
    names = documents.columns
    found = documents.withColumn("own text key", F.xxhash64(F.col(f"`{text}`"))).join(
        stored(stay, "kept"), F.col(f"`{id}`").cast("long").eqNullSafe(F.col("`keep id`")) & (F.col("`own text key`") == F.col("`keep key`")))
    once = found.where("`keep rows` = 1")
    repeated = found.where("`keep rows` > 1").dropDuplicates(["keep id", "keep key"])
    return once.union(repeated).select(*[F.col(f"`{c}`") for c in names])
