"""Periodic runs against a plain definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evidentry.llm import periodic, queries, recompression


def plain_runs(words, least=6, exponent=4):
    """Every stretch of words equal to the word q places on, for q from 1 on; of equal stretches the first stays."""
    seen, out = set(), []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def tandem(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 9)):
        n = rng.randint(0, 150)
        words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
        texts.append(tandem(words, rng.randrange(10**6) if rng.random() < 0.5 else 10 * rng.randrange(100)))
        if words and rng.random() < 0.5:      # a stretch repeats inside other words
            a, p = rng.randrange(n), rng.randint(1, 9)
            texts[-1] = words[:a] + (words[a:a + p] * rng.randint(2, 9)) + words[a:]
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    words = np.array([w for t in texts for w in t], np.int32)
    for least, exponent in ((6, 4), (2, 2), (5, 3)):
        got = [tuple(r) for r in periodic.runs_of(words, bounds, least, exponent).tolist()]
        assert got == [(t, *r) for t, text in enumerate(texts) for r in plain_runs(text, least, exponent)]


@pytest.mark.parametrize("few", [0, 8])
def test_extensions(few, monkeypatch):
    monkeypatch.setattr(recompression, "FEW_SYMBOLS", few)
    rng = random.Random(few)
    for _ in range(40):
        text = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(2, 90))] * rng.randint(1, 4)
        seq = np.array([*text, 9, *text[::-1], 10], np.int32)
        grammar = recompression.build(seq, seq >= 9)
        pairs = np.array([(i, j) for i in range(len(seq)) for j in range(i + 1, len(seq)) if max(seq[i], seq[j]) < 9])
        pairs = pairs[np.random.default_rng(1).permutation(len(pairs))[:500]]
        ahead, back = (f(grammar, pairs[:, 0], pairs[:, 1]) for f in (recompression.forward, recompression.backward))
        for (i, j), x, y in zip(pairs.tolist(), ahead.tolist(), back.tolist(), strict=True):
            assert (seq[i:i + x] == seq[j:j + x]).all() and seq[i + x] != seq[j + x]
            assert (seq[i - y + 1:i + 1] == seq[j - y + 1:j + 1]).all() and (i - y < 0 or seq[i - y] != seq[j - y])


def test_long_runs_of_one_word():
    rows = periodic.runs_of(np.r_[np.zeros(50_000), 1, np.zeros(7)].astype(np.int32), np.array([0, 50_008]))
    assert rows.tolist() == [[0, 0, 50_000, 1], [0, 50_001, 7, 1]]


def test_rows(spark, odd):
    """Nulls, empty and blank texts, repeated rows, no rows, columns with clashing names."""
    rows = periodic.periodic_runs(odd.withColumnRenamed("source", "runs")).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {"doc_id", "score", "rest", "runs", "collapsed"}
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert (r["runs"], r["collapsed"]) == ([], "")
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


def test_query_equals_the_definition(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " \t".join(rng.choice(["a", "A", "b", "ça", "d e"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    docs += [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 300)))) for i in range(300, 500)]
    docs += [(600, None), (601, ""), (602, " \n"), (0, "x " * 30), (0, "x " * 30), (None, "y " * 8)]
    spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = tandem(words, doc_id) if doc_id is not None else words
        runs = plain_runs(words)
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        expected.append((doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                         hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                         hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()))
    assert got == sorted(expected, key=str)
