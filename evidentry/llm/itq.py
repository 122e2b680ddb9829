"""Embedding near-duplicates: iterative quantisation, many Hamming tables, exact rerank.

Rotations are learnt on a bounded sample so that the signs of the rotated vectors are balanced
codes of 64 bits. `CODES` independent rotations give as many codes; each is cut into four
substrings of 16 bits, one hash table each. Two vectors are candidates if they agree in some
substring. At cosine 0.9 a code differs in about 9 bits, so one code alone meets in 3 of 10
pairs and 24 codes meet in all but a few of 10,000 (see README). Codes go in groups of two:
candidates whose two codes differ in more than 2 * `RADIUS` bits are dropped, the others are
compared by their original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, stored
from .components import components

THRESHOLD = 0.9
BITS, TABLES = 64, 4
WIDTH = BITS // TABLES
CODES, GROUP = 24, 2     # independent codes of a vector; codes of a group are compared together
RADIUS = 24              # of 64 bits; at cosine 0.9 about 9 differ
SAMPLE = 20_000          # vectors the rotation is fitted on, the smallest hashes of the whole table
ROUNDS, MORE_ROUNDS = 40, 5   # of the first rotation, of each further one


def fit_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) so that sign((x - mean) @ projection) is the code of a unit vector x.

    Each block of at most `dim` bits has its own ITQ rotation of the leading principal
    directions; blocks are appended until there are `bits` columns. Without a sample the
    mean is zero and the rotations are random.
    """
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    if len(sample) > 1:
        _, vectors = np.linalg.eigh(centred.T @ centred)
        directions = vectors[:, ::-1]
    else:
        directions = np.eye(dim)
    columns = []
    while sum(c.shape[1] for c in columns) < bits:
        width = min(dim, bits - sum(c.shape[1] for c in columns))
        basis = directions[:, :width]
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        reduced = centred @ basis
        for _ in range(rounds if len(sample) > 1 else 0):
            codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ reduced)
            rotation = (u @ vt).T
        columns.append(basis @ rotation)
    return mean, np.concatenate(columns, axis=1)


def fit_rotations(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of `CODES` independent rotations, their columns side by side."""
    fits = [fit_rotation(sample, rounds=MORE_ROUNDS if k else ROUNDS, seed=7 + k) for k in range(CODES)]
    return fits[0][0], np.concatenate([projection for _, projection in fits], axis=1)


def _dense(array: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(array.flatten(), dtype=np.float64).reshape(-1, dim)


def _encode(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64))
        for batch in batches:
            vectors = batch.column("vector")
            dims = np.asarray(batch.column("dim"))
            codes = np.zeros((batch.num_rows, CODES), np.uint64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                mean, projection = models.get(dim) or fit_rotations(np.empty((0, dim)))
                x = _dense(vectors.take(pa.array(at)), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for k in range(CODES):
                    codes[at, k] = ((x - mean) @ projection[:, k * BITS:(k + 1) * BITS] >= 0).astype(np.uint64) @ weights
            edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * CODES)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "dim": batch.column("dim"), "codes": pa.ListArray.from_arrays(
                edges, pa.array(codes.reshape(-1).view(np.int64)))})
    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        cosine = np.zeros(batch.num_rows)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            a, b = (_dense(batch.column(c).take(pa.array(at)), dim) for c in ("va", "vb"))
            cosine[at] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "cosine": pa.array(cosine)})


def _first_table(xors: list[Column]) -> Column:
    """The first table of a group in which two vectors meet, so that a pair is taken there only."""
    out = F.lit(None).cast("int")
    for t in reversed(range(len(xors) * TABLES)):
        part = F.shiftrightunsigned(xors[t // TABLES], t % TABLES * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
        out = F.when(part == 0, F.lit(t)).otherwise(out)
    return out


def candidates(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of `codes(id, dim, codes)` that meet in a table and within `radius` bits a code of its group.

    A pair comes out of a group of codes in its first table there, and once in all.
    """
    members = [f"code{k}" for k in range(GROUP)]
    tables = codes.select("id", "dim", "codes", F.explode(F.sequence(F.lit(0), F.lit(CODES * TABLES - 1))).alias("table"))
    own = f"shiftrightunsigned(codes[table div {TABLES}], table % {TABLES} * {WIDTH}) & {(1 << WIDTH) - 1}L"
    # one number for length, table and substring
    index = tables.select(
        "id", F.expr(f"shiftleft(cast(dim AS long), {WIDTH + 8}) | shiftleft(cast(table AS long), {WIDTH}) | ({own})").alias("bucket"),
        *[F.expr(f"codes[cast(table div {GROUP * TABLES} AS int) * {GROUP} + {k}]").alias(c) for k, c in enumerate(members)])
    other = index.select("bucket", F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in members])
    xors = [F.col(c).bitwiseXOR(F.col(f"b_{c}")) for c in members]
    table = F.shiftright("bucket", WIDTH).bitwiseAND(F.lit(255).cast("long")) % (GROUP * TABLES)
    met = index.withColumnRenamed("id", "a").join(other, "bucket").where(
        (F.col("a") < F.col("b")) & (sum((F.bit_count(x) for x in xors[1:]), F.bit_count(xors[0])) <= GROUP * radius)
        & (_first_table(xors) == table))
    return met.select("a", "b").distinct()


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Pairs (a, b, cosine) of `vectors(id, vector, dim)` with a cosine of `threshold` or more.

    All pairs given are right; of those near the threshold a few are not found (the
    README has the recall by cosine).
    """
    models = {}
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector", "dim").toArrow()
    dims = picked["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        x = _dense(picked["vector"].combine_chunks().take(pa.array(np.flatnonzero(dims == dim))), dim)
        models[dim] = fit_rotations(x / np.linalg.norm(x, axis=1, keepdims=True))
    codes = stored(vectors.mapInArrow(_encode(models), "id long, dim int, codes array<long>"), "codes")
    pairs = candidates(codes)
    left = vectors.select(F.col("id").alias("a"), "dim", F.col("vector").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", "dim", "va", "vb").mapInArrow(
        _cosines, "a long, b long, cosine double")
    return compared.where(F.col("cosine") >= threshold)


def embedding_groups(table: DataFrame, id: str = "vec_id", embedding: str = "embedding",
                     threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept (id = component_id).

    Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal vectors are one node with a count, so
    a group of copies costs one comparison; they link with each other. Rows with a null id
    count as linked vectors and are named by their component. Repeated rows give repeated
    results; an empty table gives none.
    """
    rows = table.select(F.col(f"`{id}`").cast("long").alias("id"),
                        F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.when(largest.between(1e-100, 1e100), F.col("vector")).otherwise(
        F.transform("vector", lambda x: x / largest))
    rows = rows.select("id", F.when(usable, scaled).alias("vector"))
    rows = rows.select("id", "vector", *digest(F.col("vector")))
    rows = stored(rows, "vectors")
    good = rows.where("vector is not null")
    # F.first is safe: all vectors of a digest are equal
    nodes = good.groupBy("digest_a", "digest_b").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    nodes = stored(nodes, "distinct-vectors")
    links = stored(embedding_links(nodes.select("id", "vector", "dim"), threshold, sample), "vector-links")
    copies = nodes.select(F.col("id").alias("n"), "copies")
    both = links.select("a", F.col("b").alias("n")).union(links.select("b", F.col("a").alias("n")))
    degree = both.join(copies, "n").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "id")
    labels = components(links.select("a", "b")).withColumnRenamed("node", "id")
    named = nodes.select("id", "digest_a", "digest_b", "least", "copies").join(labels, "id", "left").join(degree, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        "digest_a", "digest_b", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    grouped = good.select("id", "digest_a", "digest_b").join(stored(named, "named-vectors"), ["digest_a", "digest_b"]).select(
        "id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return grouped.union(alone).select(
        F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
