"""Positive-unlabelled quality: numbers against plain Python, the prior, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidentry.llm import quality

TEXTS = ["", None, "One two, two TWO.\nThree###", " \t\n", "a", "é 12 x-y !! ==", "word " * 300, "the cat the cat the cat the cat", "ab\nab\n"]


def plain(text):
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    n, some, size = len(words), max(1, len(words)), max(1, len(raw))
    upper, lower = (sum(chr(b) in a for b in raw) for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    marks, blank = b".,;:!?'\"()-", b" \t\n\v\f\r"
    symbol = lambda b: not (chr(b).isalnum() and b < 128 or b in marks or b in blank or b > 127)
    mean = sum(map(len, words)) / some
    runs = lambda k: [tuple(words[i:i + k]) for i in range(n - k + 1)]
    old = lambda k: 1 - len(set(runs(k))) / len(runs(k)) if n >= k else 0
    lines = raw.count(b"\n") + 1
    return {
        "words": math.log1p(n), "word_bytes": math.log1p(mean), "word_spread": math.log1p(math.sqrt(sum((len(w) - mean) ** 2 for w in words) / some)),
        "upper": upper / max(1, upper + lower), "digits": sum(48 <= b < 58 for b in raw) / size, "marks": sum(b in marks for b in raw) / size,
        "symbols": sum(map(symbol, raw)) / size, "blanks": sum(b in blank for b in raw) / size, "high_bytes": sum(b > 127 for b in raw) / size,
        "entropy": -sum(c / size * math.log2(c / size) for c in (raw.count(bytes([b])) for b in set(raw))),
        "symbol_ends": sum(symbol(w[-1]) for w in words) / some, "mark_ends": sum(w[-1] in marks for w in words) / some,
        "short_words": sum(len(w) <= 3 for w in words) / some, "no_letters": sum(not any(97 <= b < 123 or b > 127 for b in w) for w in words) / some,
        "new_words": len(set(words)) / some, "log_new_words": math.log1p(len(set(words))) / math.log1p(n) if n > 1 else 1,
        "top_word": max((words.count(w) for w in set(words)), default=0) / some,
        "doubled": sum(a == b for a, b in zip(words, words[1:])) / some, "repeated_pairs": old(2), "repeated_fours": old(4),
        "lines": math.log1p(lines), "line_words": math.log1p(n / lines), "same_bytes": sum(a == b for a, b in zip(raw, raw[1:])) / size}


def test_numbers_equal_plain_python():
    got = quality.features(pa.array(TEXTS))
    for text, row in zip(TEXTS, got, strict=True):
        want = plain(text)
        assert list(want) == list(quality.FEATURES)
        assert row == pytest.approx([want[f] for f in quality.FEATURES], abs=1e-6), text
    assert quality.features(pa.array(["x", *TEXTS, "y"]).slice(1, len(TEXTS))) == pytest.approx(got)
    assert quality.features(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def _corpus(n, bad, seed):
    """(texts, good): bad texts shout, repeat or are strewn with symbols."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "st", "ea", "in", "th"]) for _ in range(rng.randint(1, 4)))
    texts, good = [], []
    for _ in range(n):
        words = [word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(8, 150))]
        kind = rng.randrange(3) if rng.random() < bad else -1
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w for w in words[:len(words) // 5 + 1] for _ in range(5)]
        elif kind == 2:
            words = [w + rng.choice(["###", "$$$", "&&&"]) for w in words]
        texts.append(" ".join(words))
        good.append(int(kind < 0))
    return texts, np.array(good)


def test_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.beta(6, 2, 40_000), rng.beta(2, 6, 40_000)
    for share in (0.3, 0.6, 0.9):
        mixed = np.r_[good[20_000:20_000 + int(20_000 * share)], bad[:20_000 - int(20_000 * share)]]
        counts = [np.histogram(x, 1_000, (0, 1))[0] for x in (good[:20_000], mixed)]
        assert abs(quality.estimate_prior(*counts) - share) < 0.06
    assert quality.estimate_prior(np.zeros(10), np.ones(10)) == 0.5


@pytest.mark.parametrize("bad", [0.15, 0.5])
def test_held_out_accuracy(bad):
    texts, good = _corpus(3_000, bad, 1)
    x = quality.features(pa.array(texts))
    model = quality.fit(x[:1_500][good[:1_500] == 1], x[1_500:], 1 - bad)
    other, truth = _corpus(600, bad, 2)
    score = quality.probability(quality.features(pa.array(other)), model)
    assert ((score >= 0.3) == truth).mean() > 0.97 and score[truth == 1].mean() > 0.9 > 0.2 > score[truth == 0].mean()


def test_scored_rows(spark, odd):
    """Labels of bad texts and of the held-out fifth teach nothing; odd rows and empty tables give scores."""
    texts, good = _corpus(1_500, 0.2, 3)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, features string")
    marks = [(i, int(good[i])) for i in range(0, 1_500, 2)] + [(None, 1), (2_000, None)]
    score = lambda d, rows: {r["doc_id"]: r["quality_score"] for r in
                             quality.scored(d, spark.createDataFrame(rows, "doc_id long, quality int")).collect()}
    found = score(docs, marks)
    held = {r["doc_id"] for r in docs.where(quality.held_out(docs["doc_id"])).collect()}
    assert ((np.array([found[i] for i in sorted(held)]) >= 0.3) == good[sorted(held)]).mean() > 0.95
    assert score(docs, [(i, 1 - y if i in held else y) for i, y in marks]) == found
    rows = quality.scored(odd, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int"), score="score").collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {"doc_id", "source", "rest", "score"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert set(score(docs.limit(20), []).values()) == {quality.FLAT}
    assert score(docs.limit(0), marks) == {}
