"""Hard negatives against scoring every pair."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentry.llm import hardneg, queries

SCHEMA = "vec_id long, label int, vector array<long>, score string, rank int"


def plain(rows, positives=5, negatives=3, low=50, high=95, every=50):
    kept = {}
    for id_, label, v in sorted((r for r in rows if None not in r and None not in r[2]), key=lambda r: (r[0], r[1], len(r[2]), r[2])):
        kept.setdefault((id_, label, len(v)), (id_, label, v))
    rows = list(kept.values())
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in rows if len(v) == len(va)]
        for s, p, _ in sorted(r for r in scored if r[2] == la and r[1] != a)[:positives]:
            fit = sorted(r for r in scored if r[2] != la and low * -s <= 100 * -r[0] <= high * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def mined(spark, rows, every=50, **more):
    found = hardneg.hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % every == 0, id="vec_id", **more).collect()
    assert not found or found[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found)


@pytest.mark.parametrize("seed,values,size,block", [(1, 3, 4, 16), (2, 40, 8, 64), (3, 2, 1, 7), (4, 300, 16, 4096), (5, 2**40, 3, 32), (6, 1, 2, 16)])
def test_equals_all_pairs(spark, seed, values, size, block):
    """Ties (few values), long products (Python integers), blocks of several labels, a hot label."""
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randrange(6), [rng.randint(-values // 3, values) for _ in range(size)]) for i in range(0, 500)]
    if values > 2**32:
        rows = [(i, label, [x // 2**12 for x in v]) for i, label, v in rows]
    assert mined(spark, rows, every=10, rows_per_block=block) == plain(rows, every=10) != []


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, i % 3, [rng.randint(-9, 30) for _ in range(4)]) for i in range(120)]
    odd = [(None, 1, [1, 2, 3, 4]), (50, None, [1, 2, 3, 4]), (100, 1, None), (51, 1, [1, None, 3, 4]), (150, 1, []), (200, 1, []), (250, 2, []),
           (300, 1, [5, 5]), (301, 1, [5, 4]), (302, 2, [4, 3]), (350, 2, [0, 0, 0, 0]), (400, 77, [9, 9, 9, 9])]
    rows = rows + odd + rows[:30] + [(0, 0, [99, 0, 0, 0])]
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 50]) == []
    assert mined(spark, [(0, 1, [1]), (1, 1, [1])]) == []


def test_search_stops_early():
    """Far rows are never met, and ties at the last place are found."""
    rng = np.random.default_rng(1)
    v = np.r_[rng.integers(-3, 3, (4000, 4)), np.full((8, 4), 200)].astype(np.int64)
    block = hardneg.Block(np.arange(4008)[::-1].copy(), np.zeros(4008, np.int64), np.zeros(4008, bool), v)
    lists = hardneg.Lists(block)
    met = []
    lists.exact = type("Counted", (), {"__getitem__": lambda self, at: (met.extend(at.tolist()), block.vectors[at].astype(float))[1]})()
    assert lists.search(np.ones(4, np.int64), np.ones(4008, bool), [(None, None)], 3)[0] == [(800, 4007), (800, 4006), (800, 4005)]
    assert len(met) < 400


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randrange(4), [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    odd = [(600, None, [0.1] * 6), (650, 1, None), (700, 1, [0.1, None]), (750, 1, [float("nan")] * 6), (800, 1, [float("inf")] + [0.1] * 5)]
    spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, label, v in rows]
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()) == plain(whole) != []
