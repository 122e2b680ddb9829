"""SimHash, embeddings, components, containment and substrings against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from evidentry.llm import common, components, containment, itq, simhash, substring


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 520)]
    pairs += [(600, i) for i in range(601, 700)] + [(None, 1), (5, 5), (600, 601)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    nodes = {n for p in real for n in p}
    got = {r["node"]: r["component"] for r in components.components(frame).collect()}
    assert got == brute_components(nodes, real)
    assert components.components(frame.limit(0)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " ", "One", "one TWO three", "a b c d", "É b c d e f é", "x " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def _leaves(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for k in range(1, 6):   # copies with k flipped bits
        flips = np.zeros(n, np.uint64)
        for _ in range(k):
            flips ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        out.append(base ^ flips)
    dense = rng.integers(0, 2**64, 1, dtype=np.uint64) ^ (rng.integers(0, 2**9, 60, dtype=np.uint64) << np.uint64(40))
    return np.unique(np.concatenate([*out, dense]))


def test_trie_links(spark):
    leaves = _leaves(40, 5)
    linked = [(int(leaves[i]), int(leaves[j])) for i in range(len(leaves))
              for j in np.flatnonzero(np.bitwise_count(leaves[i + 1:] ^ leaves[i]) <= 4) + i + 1]
    expected = brute_components([int(x) for x in leaves], linked)
    frame = spark.createDataFrame([(int(x),) for x in leaves.view(np.int64)], "fp long")
    for most in (5_000, 30):     # 30: node pairs are expanded again and again
        links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.trie_links(frame, most).collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
        assert brute_components([int(x) for x in leaves], links) == expected


def test_simhash_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = simhash.simhash_groups(odd).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in prints)
    least = {p: min((i for (i, _), q in zip(rows, prints) if bin(p ^ q).count("1") <= 4 and i is not None), default=None) for p in prints}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {
        (i, f"{p:016x}", least[p]) for (i, _), p in zip(rows, prints)}
    kept = simhash.simhash_distinct(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0)) == [1, 2, 5, 6, 6, None]
    assert simhash.simhash_groups(odd.limit(0)).count() == 0 and simhash.simhash_distinct(odd.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 32))
    rows = [base]
    for scale in (0.02, 0.1, 0.3, 0.45):
        rows.append(base[:60] + scale * rng.standard_normal((60, 32)))
    x = np.concatenate([*rows, np.repeat(base[:1], 40, axis=0) * 3.0])
    data = [(int(i), v.tolist(), "clash") for i, v in enumerate(x)]
    n = len(x)
    data += [(n, None, ""), (n + 1, [0.0] * 32, ""), (n + 2, [float("nan")] * 32, ""), (n + 3, [float("inf")] + [1.0] * 31, ""),
             (n + 4, [None] + [1.0] * 31, ""), (n + 5, [], ""), (n + 6, [1.0, 2.0], ""), (n + 7, [1.0, 2.0], "")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, component_id string")
    got = {r["vec_id"]: r for r in itq.embedding_groups(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    true = int(near.sum()) - n
    found = sum(got[i]["n_links"] for i in range(n))
    assert found <= true and found >= 0.99 * true
    expected = brute_components(range(n), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    assert np.mean([got[i]["component_id"] == expected[i] for i in range(n)]) > 0.99
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[n + 7]["n_links"], got[n + 7]["component_id"], got[n + 7]["kept"]) == (1, n + 6, False)
    assert itq.embedding_groups(frame.limit(0)).count() == 0


def test_embedding_links_near_the_threshold(spark):
    """Pairs planted at exact cosines among isotropic vectors, where the codes differ most."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(rng.standard_normal((2000, 64)))
    cosines = np.repeat([0.901, 0.91, 0.92, 0.93], 500)
    side = rng.standard_normal(base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([base, cosines[:, None] * base + np.sqrt(1 - cosines ** 2)[:, None] * side])
    frame = spark.createDataFrame([(i, v.tolist(), 64) for i, v in enumerate(x)], "id long, vector array<double>, dim int")
    got = [(r["a"], r["b"]) for r in itq.embedding_links(frame).collect()]
    near = x @ x.T >= 0.9
    assert len(got) == len(set(got)) and all(a < b and near[a, b] for a, b in got)
    found = np.isin(np.arange(2000), [a for a, b in got if b == a + 2000])
    for c in (0.901, 0.91, 0.92, 0.93):
        assert found[cosines == c].mean() >= 0.99, c


def _words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_leaks(spark, odd):
    rng = random.Random(8)
    items = [(i, " ".join(_words(rng, rng.choice([5, 7, 12, 30, 60, 200])))) for i in range(40)] + [
        (40, "only three words"), (41, None), (42, ""), (None, "no id here at all")]
    docs = []
    for d in range(160):
        w = _words(rng, rng.randint(0, 3000))
        for _ in range(d % 4):
            item = items[rng.randrange(40)][1].split()
            if d % 3 == 0:                     # an edit; some fall below the threshold
                item[len(item) // 2] = "edited"
            if d % 8 == 1:                     # in two halves, far apart
                at = rng.randrange(len(w) + 1)
                w[at:at] = item[:len(item) // 2]
                w += item[len(item) // 2:]
                continue
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((d, " ".join(w)))
    docs += [(200, "Only THREE words"), (201, None), (202, ""), (203, " ".join(t for _, t in items[:40]))]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    wanted = {(i, g): None for i, t in items if i is not None and (g := frozenset(grams(t)))}
    expected = {(d, i, len(g & grams(t)), len(g)) for d, t in docs for i, g in wanted if len(g & grams(t)) >= 0.8 * len(g) - 1e-9}
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in containment.leaking_documents(frame, tests).collect()}
    assert got == expected and len(got) > 100
    kept = containment.without_leaks(frame, tests)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in expected}
    assert containment.without_leaks(odd, tests).count() == odd.count()
    assert containment.leaking_documents(frame.limit(0), tests).count() == 0
    assert containment.without_leaks(frame, tests.limit(0)).count() == frame.count()


def brute_substring(docs):
    """Removed word ranges by the definition, from plain Python lists."""
    import pyarrow as pa

    from evidentry.llm import tokens
    places: dict = {}
    everything = {}
    for rank, (d, text) in enumerate(docs):
        lines = (text or "").split("\n")
        words, units = [], []
        for line in lines:
            own = [w.lower() for w in line.split()]
            if len(own) >= substring.LINE_WORDS:
                units.append((("line", *own), len(words), -len(own)))
            words += own
        h = tokens.tokenize(pa.array([text], pa.string())).hash
        for place in substring.passage_units(h)[0].tolist():
            units.append((("run", *words[place:place + substring.RUN]), place, substring.RUN))
        everything[d] = (len(words), units)
        for unit, place, _ in units:
            places.setdefault(unit, []).append((rank, place))
    out = {}
    for rank, (d, _) in enumerate(docs):
        n, units = everything[d]
        split = lambda later: np.array([(p, w) for u, p, w in units if len(places[u]) > 1 and (
            min(places[u]) != (rank, p)) == later], np.int64).reshape(-1, 2)
        out[d] = substring.removed_words(n, split(True), split(False))
    return out


def test_substring(spark, odd):
    rng = random.Random(4)
    passages = [_words(rng, n) for n in (55, 80, 120)]
    docs = []
    for d in range(60):
        w = _words(rng, rng.randint(0, 200))
        at = rng.randrange(len(w) + 1)
        w[at:at] = passages[d % 3] if d % 2 else []
        lines = [" ".join(w), "the same boiler plate line here", " ".join(_words(rng, 4))]
        rng.shuffle(lines)
        docs.append((d, "\n".join(lines) if d % 7 else lines[0] + " é " + lines[1]))
    docs += [(70, "a b " * 100), (71, docs[3][1]), (72, None), (73, "")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, marks string")
    rows = {r["doc_id"]: r for r in substring.deduplicated(frame).collect()}
    expected = brute_substring(docs)
    texts = dict(docs)
    for d, ranges in expected.items():
        assert [s["words"] for s in rows[d]["removed"]] == [hi - lo for lo, hi in ranges], d
        at, left = 0, []
        for s in rows[d]["removed"]:
            left.append(texts[d][at:s["start"]])
            at = s["end"]
        assert rows[d]["text"] == (None if texts[d] is None else "".join([*left, texts[d][at:]]))
    # what is left holds no long run twice, and first occurrences stay
    seen: dict = {}
    for d, r in rows.items():
        w = (r["text"] or "").split()
        if d != 70:
            for k in range(len(w) - 39):
                assert seen.setdefault(tuple(w[k:k + 40]), d) == d
    for p in passages:
        assert sum(" ".join(p) in (r["text"] or "") for r in rows.values()) == 1
    twice = substring.deduplicated(substring.deduplicated(frame))   # the spans of a first run are replaced
    assert twice.columns == ["doc_id", "marks", "text", "removed"] or set(twice.columns) == {"doc_id", "text", "marks", "removed"}
    same = substring.deduplicated(odd)
    assert same.columns == [*odd.columns, "removed"] and same.count() == odd.count()
    assert substring.deduplicated(odd.limit(0)).count() == 0


def test_frequent_units_take_another_way(spark, monkeypatch):
    """One line in every document and others in two: whatever counts as frequent, marks are the same."""
    shared = "this very common line is part of every document"
    rows = [(i, f"{shared}\nline {i // 2} that two documents share by chance\nonly document {i} has this one here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = lambda: sorted(tuple(r) for r in substring.repeated_units(docs).collect())
    counts = spark.createDataFrame([(1, 1_000_000), *[(k, 3) for k in range(2, 100)]], "h long, n long")
    assert [r["h"] for r in common.frequent(counts).collect()] == [1]
    assert common.frequent(counts.limit(0)).count() == 0
    found = marks()
    assert len(found) >= 120
    for share in ("false", "true"):
        monkeypatch.setattr(substring, "frequent", lambda c, share=share: c.where(share))
        assert marks() == found
