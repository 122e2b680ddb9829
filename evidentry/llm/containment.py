"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so plain MinHash similarity of the two says nothing.
Three steps keep the compared sets of like size:

1. A filter over all item shingles thins every document to the shingles that an item may
   have; the containment of any item in the thinned document stays what it was.
2. Items are partitioned by size. For the partition of up to 4g shingles, windows of 5g
   shingles at steps of g over the thinned document take the place of the document, so an
   item meets a window at most a few times its size. MinHash signatures of items and
   windows are joined on their single values.
3. Candidates are verified by exact containment in the whole document.

With `HASHES` values, an item with containment 0.8 is missed with probability below 1e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import digest, slices, stored
from .tokens import constants, mix, shingles, tokenize

SHINGLE, THRESHOLD = 5, 0.8
HASHES = 64
SMALLEST = 4              # g of the first partition
SLICE_BYTES = 4_000_000

SETS = "key_a long, key_b long, shingles array<long>, signature array<long>"


def size_class(n: int) -> int:
    """Partition of an item with n shingles: up to 16, 32, 64, ..."""
    return max(0, math.ceil(math.log2(max(1, n) / (4 * SMALLEST))))


def signature(values: np.ndarray, kind: int) -> np.ndarray:
    """Join keys of a set: its HASHES minima, each mixed with its number and the size partition."""
    multiply = constants(HASHES, 11)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(values), 4096):
        least = np.minimum(least, mix(values[None, lo:lo + 4096] * multiply[:, None]).min(axis=1))
    return mix(least + np.arange(HASHES, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(kind) * multiply[0])


def windows(values: np.ndarray, classes: list[int]) -> np.ndarray:
    """Distinct join keys of all windows over an ordered sequence of shingles."""
    keys = []
    for kind in classes:
        g = SMALLEST << kind
        seen = 0
        for lo in range(0, max(1, len(values) - 4 * g), g):
            keys.append(signature(values[lo:lo + 5 * g], kind))
            seen += 1
            if seen % 256 == 0:
                keys = [np.unique(np.concatenate(keys))]
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            tokens = tokenize(batch.column("text"))
            place, value = shingles(tokens, SHINGLE)
            cut = np.searchsorted(place, tokens.bounds)
            sets = [np.unique(value[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]
            kinds = [size_class(len(s)) for s in sets]
            signs = [signature(s, k) if len(s) else s for s, k in zip(sets, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(sets), _lists(signs), pa.array(kinds, pa.int32())],
                                             names=["id", "shingles", "signature", "kind"])


def _documents(known: np.ndarray, classes: list[int], fewest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                tokens = tokenize(batch.column("text"))
                place, value = shingles(tokens, SHINGLE)
                may = filters.contains(known, value)
                place, value = place[may], value[may]
                cut = np.searchsorted(place, tokens.bounds)
                rows = np.flatnonzero(np.diff(cut) >= fewest)
                parts = [value[cut[r]:cut[r + 1]] for r in rows]
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key_a").take(take), batch.column("key_b").take(take),
                     _lists([np.unique(p) for p in parts]), _lists([windows(p, classes) for p in parts])],
                    names=["key_a", "key_b", "shingles", "signature"])
    return run


def leaks(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(key_a, key_b, item, shared, n, containment): texts that hold `threshold` or more of an item.

    key_a, key_b are the digest of the whole text, so equal texts are searched once per row
    and joined once per digest. containment = shared / n, of n distinct five-word shingles of
    the item. Texts and items of fewer than five words have their whole sequence as their only
    shingle; null and empty ones have none and match nothing. Repeated items count once.
    """
    tests = stored(items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where("id is not null").distinct()
                   .mapInArrow(_items, "id long, shingles array<long>, signature array<long>, kind int")
                   .where(F.size("shingles") > 0), "items")
    about = tests.agg(F.min(F.size("shingles")).alias("least"), F.collect_set("kind").alias("kinds")).first()
    least, kinds = about["least"] or 1, sorted(about["kinds"])
    known = filters.build(tests.select(F.explode("shingles").alias("h")), "h")
    source = documents.select(F.col(f"`{text}`").alias("text")).select("text", *[
        d.alias(k) for d, k in zip(digest(F.col("text")), ("key_a", "key_b"))])
    thinned = stored(source.mapInArrow(_documents(known, kinds, max(1, math.ceil(threshold * least - 1e-9))), SETS), "thinned")
    # documents that leak the same passage mostly have the same thinned set: search each set once
    sets = thinned.select("key_a", "key_b", "shingles", "signature", *[
        d.alias(k) for d, k in zip(digest(F.col("shingles"), F.col("signature")), ("set_a", "set_b"))])
    unique = stored(sets.groupBy("set_a", "set_b").agg(
        F.any_value("shingles").alias("shingles"), F.any_value("signature").alias("signature")), "thinned-sets")
    met = unique.select("set_a", "set_b", F.explode("signature").alias("k")).join(
        tests.select(F.col("id").alias("item"), F.xxhash64("shingles").alias("version"), F.explode("signature").alias("k")), "k"
    ).select("set_a", "set_b", "item", "version").distinct()
    shared = F.size(F.array_intersect("shingles", "wanted"))
    found = met.join(unique.select("set_a", "set_b", "shingles"), ["set_a", "set_b"]).join(
        tests.select(F.col("id").alias("item"), F.xxhash64("shingles").alias("version"), F.col("shingles").alias("wanted")),
        ["version", "item"])
    found = found.select("set_a", "set_b", "item", shared.cast("long").alias("shared"), F.size("wanted").cast("long").alias("n"))
    found = stored(found.where(F.col("shared") >= F.col("n") * threshold - 1e-9), "found")
    return sets.select("key_a", "key_b", "set_a", "set_b").distinct().join(found, ["set_a", "set_b"]).select(
        "key_a", "key_b", "item", "shared", "n", (F.col("shared") / F.col("n")).alias("containment")).distinct()


def leaking_documents(documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Pairs (id, item_id, shared, item_shingles, containment) of documents and the items they hold.

    Items with a null id are left out. Repeated documents repeat their pairs; empty tables
    give no rows.
    """
    ids = documents.select(F.col(f"`{id}`").alias(id), *[
        d.alias(k) for d, k in zip(digest(F.col(f"`{text}`")), ("key_a", "key_b"))])
    return ids.join(leaks(documents, items, text, **options), ["key_a", "key_b"]).select(
        id, F.col("item").alias("item_id"), "shared", F.col("n").alias("item_shingles"), "containment")


def without_leaks(documents: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """`documents` without the rows whose text holds an item; columns and repeated rows stay."""
    names = documents.columns
    bad = leaks(documents, items, text, **options).select(F.col("key_a").alias("leak a"), F.col("key_b").alias("leak b")).distinct()
    keyed = documents.select("*", *[d.alias(k) for d, k in zip(digest(F.col(f"`{text}`")), ("text digest a", "text digest b"))])
    kept = keyed.join(bad, (F.col("`text digest a`") == F.col("`leak a`")) & (F.col("`text digest b`") == F.col("`leak b`")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in names])
