"""Quality by positive-unlabelled learning: trusted good texts against unlabelled web text.

Nothing is learnt from texts that are labelled bad. Unlabelled text is a mixture of good and bad
with an unknown share of good, the class prior:

1. A plain logistic model tells trusted texts from unlabelled ones. All documents are scored by it
   (each half by the model of the other) and counted in bins; where trusted texts are frequent, unlabelled ones are so by the prior at
   least. The prior is the least ratio of the two counts over all upper and lower tails, each with
   an allowance for its sampling error.
2. The model of the result minimises the non-negative unbiased risk
   prior * E_trusted[loss(f)] + max(0, E_unlabelled[loss(-f)] - prior * E_trusted[loss(-f)])
   first with the logistic loss, then from there with the sigmoid loss, which is bounded: far from
   the border trusted and unlabelled good texts cancel out in it, whatever their scores are.
   Where the second part falls below zero the step goes up its gradient instead, which keeps
   the model from explaining away single texts.

A text is described by `FEATURES` numbers of its form (kinds of bytes, word lengths, repetition,
ends of words and lines), each spread over hat functions between quantiles; the model is linear in
these. Numbers are computed once in a pass over whole texts and stored; all else reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .tokens import buffers, mix, tokenize

SAMPLE_ROWS = 10_000     # trusted texts to learn from, and as many unlabelled ones
SLICE_BYTES = 1_000_000
KNOTS = 6                # quantiles of a number; hats lie between them
BINS = 1_000             # of the scores that the prior is estimated from
STEPS = 400              # of each loss
RATE = 0.05
SHRINK = 1e-4            # of the weights, in the loss
FLAT = 0.5               # score of all texts where there is nothing to learn from

FEATURES = ("words", "word_bytes", "word_spread", "upper", "digits", "marks", "symbols", "blanks", "high_bytes", "entropy",
            "symbol_ends", "mark_ends", "short_words", "no_letters", "new_words", "log_new_words", "top_word", "doubled",
            "repeated_pairs", "repeated_fours", "lines", "line_words", "same_bytes")

_KINDS = ("upper", "lower", "digits", "marks", "symbols", "blanks", "high_bytes")


def _byte_kinds() -> np.ndarray:
    """Rows of byte values, columns of `_KINDS`."""
    kind = np.full(256, _KINDS.index("symbols"))
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    kind[[ord(c) for c in ".,;:!?'\"()-"]] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 5
    kind[128:] = 6
    return np.eye(len(_KINDS))[kind]


KIND = _byte_kinds()
_OF = KIND.argmax(axis=1)


def features(texts: pa.Array) -> np.ndarray:
    """One row of `FEATURES` for each text; null, empty and blank texts have zeros but for what they have."""
    offsets, raw = buffers(pc.fill_null(texts, ""))
    n = len(texts)
    size = np.diff(offsets)
    data = raw[int(offsets[0]):int(offsets[-1])]
    row = np.repeat(np.arange(n), size)
    histogram = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    kinds = histogram @ KIND
    share = histogram / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    same = np.bincount(row[1:][(data[1:] == data[:-1]) & (row[1:] == row[:-1])], minlength=n)
    t = tokenize(texts)
    words = np.diff(t.bounds).astype(np.float64)
    some = np.maximum(words, 1)
    length = (t.end - t.start).astype(np.float64)

    def per_row(weight: np.ndarray | None = None, at: np.ndarray = t.row) -> np.ndarray:
        return np.bincount(at, weight, minlength=n).astype(np.float64)

    mean = per_row(length) / some
    spread = np.sqrt(np.maximum(per_row(length**2) / some - mean**2, 0))
    last = _OF[raw[offsets[t.row] + t.end - 1]] if len(t.row) else np.zeros(0, int)
    # words without a letter: no bytes of a letter's kind or above 127
    letters = np.r_[0, np.cumsum((_OF[data] <= 1) | (_OF[data] == 6))]
    first = offsets[t.row] + t.start - int(offsets[0])
    bare = letters[first + (t.end - t.start)] == letters[first]

    def distinct(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct, all, most frequent) runs of k words of each row."""
        here = np.arange(max(0, len(t.row) - k + 1))
        here = here[t.row[here] == t.row[here + k - 1]] if len(here) else here
        key = t.row[here].astype(np.uint64)
        for i in range(k):
            key = mix(key + t.hash[here + i])
        _, at, number = np.unique(key, return_index=True, return_counts=True)
        owner = t.row[here[at]]
        top = np.zeros(n)
        np.maximum.at(top, owner, number)
        return per_row(at=owner), per_row(at=t.row[here]), top

    new, _, top = distinct(1)
    new2, all2, _ = distinct(2)
    new4, all4, _ = distinct(4)
    doubled = per_row(at=t.row[1:][(t.hash[1:] == t.hash[:-1]) & (t.row[1:] == t.row[:-1])]) if len(t.row) else np.zeros(n)
    lines = histogram[:, 10] + 1
    some_bytes = np.maximum(size, 1)
    of = {k: kinds[:, i] for i, k in enumerate(_KINDS)}
    out = {
        "words": np.log1p(words), "word_bytes": np.log1p(mean), "word_spread": np.log1p(spread),
        "upper": of["upper"] / np.maximum(of["upper"] + of["lower"], 1), "digits": of["digits"] / some_bytes, "marks": of["marks"] / some_bytes,
        "symbols": of["symbols"] / some_bytes, "blanks": of["blanks"] / some_bytes, "high_bytes": of["high_bytes"] / some_bytes,
        "entropy": entropy, "symbol_ends": per_row((last == 4).astype(float)) / some, "mark_ends": per_row((last == 3).astype(float)) / some,
        "short_words": per_row((length <= 3).astype(float)) / some, "no_letters": per_row(bare.astype(float)) / some,
        "new_words": new / some, "log_new_words": np.where(words > 1, np.log1p(new) / np.log1p(some), 1), "top_word": top / some,
        "doubled": doubled / some, "repeated_pairs": 1 - new2 / np.maximum(all2, 1) * (all2 > 0) - (all2 == 0),
        "repeated_fours": 1 - new4 / np.maximum(all4, 1) * (all4 > 0) - (all4 == 0),
        "lines": np.log1p(lines), "line_words": np.log1p(words / lines), "same_bytes": same / some_bytes}
    return np.stack([out[f] for f in FEATURES], axis=1)


class Model(NamedTuple):
    knots: list[np.ndarray]     # of each number, rising
    weight: np.ndarray
    bias: float


def hats(x: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    """Each number as its share of the two knots around it; numbers beyond the ends belong to the last knot there."""
    out = np.zeros((len(x), sum(map(len, knots))), np.float32)
    base = 0
    for k, edge in enumerate(knots):
        v = np.clip(x[:, k], edge[0], edge[-1])
        hi = np.clip(np.searchsorted(edge, v), 1, max(1, len(edge) - 1))
        if len(edge) == 1:
            out[:, base] = 1
        else:
            share = (v - edge[hi - 1]) / (edge[hi] - edge[hi - 1])
            out[np.arange(len(x)), base + hi - 1] = 1 - share
            out[np.arange(len(x)), base + hi] = share
        base += len(edge)
    return out


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    if not len(model.weight):
        return np.full(len(x), 1 / (1 + np.exp(-model.bias)))
    return 1 / (1 + np.exp(-np.clip(hats(x, model.knots) @ model.weight + model.bias, -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _minimise(gradient, start: np.ndarray) -> np.ndarray:
    """Adam with falling steps; weights have the bias last."""
    w, m, v = start, np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, STEPS + 1):
        g = gradient(w) + SHRINK * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Side(NamedTuple):
    """Rows of one kind, spread over hats, with the mean losses of their scores and the gradients of these."""

    x: np.ndarray

    def score(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w[:-1].astype(np.float32) + w[-1]

    def _back(self, z: np.ndarray) -> np.ndarray:
        return np.r_[self.x.T @ z.astype(np.float32), z.sum()] / len(self.x)

    def logistic(self, w: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        z = sign * self.score(w)
        return float(np.logaddexp(0, -z).mean()), self._back(-sign * _sigmoid(-z))

    def sigmoid(self, w: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        s = _sigmoid(-sign * self.score(w))
        return float(s.mean()), self._back(-sign * s * (1 - s))


def _sides(trusted: np.ndarray, mixed: np.ndarray) -> tuple[list[np.ndarray], Side, Side]:
    knots = [np.unique(np.quantile(np.r_[trusted[:, k], mixed[:, k]], np.linspace(0, 1, KNOTS))) for k in range(trusted.shape[1])]
    return knots, Side(hats(trusted, knots)), Side(hats(mixed, knots))


def fit_split(trusted: np.ndarray, mixed: np.ndarray) -> Model:
    """A logistic model that tells trusted from unlabelled rows, both with half of the weight."""
    knots, p, u = _sides(trusted, mixed)
    w = _minimise(lambda w: p.logistic(w, 1)[1] + u.logistic(w, -1)[1], np.zeros(p.x.shape[1] + 1))
    return Model(knots, w[:-1], float(w[-1]))


def fit(trusted: np.ndarray, mixed: np.ndarray, prior: float) -> Model:
    """The model of least non-negative unbiased risk. Without rows of either kind every text has the score `FLAT`."""
    if not len(trusted) or not len(mixed):
        return Model([], np.zeros(0), float(np.log(FLAT / (1 - FLAT))))
    knots, p, u = _sides(trusted, mixed)

    def descend(p_loss, u_loss, start: np.ndarray) -> np.ndarray:
        def gradient(w: np.ndarray) -> np.ndarray:
            (risk_u, bad_u), (risk_p, bad_p) = u_loss(w, -1), p_loss(w, -1)
            bad = bad_u - prior * bad_p
            return -bad if risk_u < prior * risk_p else prior * p_loss(w, 1)[1] + bad
        return _minimise(gradient, start)
    w = descend(p.logistic, u.logistic, np.zeros(p.x.shape[1] + 1))
    w = descend(p.sigmoid, u.sigmoid, w)
    return Model(knots, w[:-1], float(w[-1]))


def estimate_prior(trusted: np.ndarray, mixed: np.ndarray) -> float:
    """Share of good texts among the unlabelled, from the counts of both by bin of a score, between 0.01 and 0.99.

    In every tail of the scores, unlabelled texts have `prior` times the trusted texts' share at least, so the least
    ratio of both shares is the prior where some tail holds good texts only. The tail is chosen by the ratio plus its
    allowance for sampling error, so that a tail of a few texts is not.
    """
    p, u = float(trusted.sum()), float(mixed.sum())
    if not p or not u:
        return 0.5
    allow = sum(np.sqrt(np.log(4 / 0.05) / (2 * k)) for k in (p, u))
    of_p, of_u = (np.r_[np.cumsum(x) / x.sum(), np.cumsum(x[::-1]) / x.sum()] for x in (trusted, mixed))
    able = of_p > 0
    ratio = of_u[able] / of_p[able]
    return float(np.clip(ratio[np.argmin(ratio + 2 * allow / of_p[able])], 0.01, 0.99))


def held_out(id: Column) -> Column:
    """Whether a document is never learnt from."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def described(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` as they are (in a struct `rest`) and the array `features` of every row's text."""
    body = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).cast("int")]).alias("rest"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([body.schema["rest"], T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                x = features(batch.column("text")).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_pydict({"rest": batch.column("rest"), "features": flat})
    return body.mapInArrow(run, schema)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(FEATURES))


def _scores(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (rest, features) with `score` instead of the features."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "features"] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f: batch.column(f) for f in batch.schema.names if f != "features"}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(probability(_matrix(batch.column("features")), model))})
    return rows.mapInArrow(run, schema)


class Learnt(NamedTuple):
    model: Model
    prior: float


def learn(rows: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", sample: int = SAMPLE_ROWS) -> Learnt:
    """Model and prior from `described` rows (whose `rest` has `id`) and `labels` (id, 0 or 1).

    Trusted texts are those with a label 1 (and none of 0) outside the held-out fifth; unlabelled ones have no label
    and are outside it too. At most `sample` of each are learnt from, by the hash of their ids; the prior is
    estimated from all of them. Where every text has a label, all texts stand for unlabelled ones.
    """
    marked = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        "id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    known = rows.select(F.col("rest").getField(id).alias("id"), "features")
    known = known.where(~held_out(F.col("id"))).join(marked, "id", "left")
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("features")]
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)).cast("int").alias("fold")
    trusted = known.where("y = 1").select("id", fold, "features")
    mixed = known.where("y is null").select("id", fold, "features")
    if mixed.isEmpty():
        mixed = known.select("id", fold, "features")

    def taken(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = part.orderBy(*order).limit(sample).select("fold", "features").toArrow()
        return rows["fold"].to_numpy(), _matrix(rows["features"])
    (p_fold, p), (u_fold, u) = taken(trusted), taken(mixed)
    priors = []
    for turn in (0, 1):
        halves = p[p_fold != turn], u[u_fold != turn]
        if not all(map(len, halves)):
            continue
        of = [part.where(F.col("fold") == turn).select("features", F.lit(y).alias("y")) for y, part in ((1, trusted), (0, mixed))]
        bin = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
        counts = np.zeros((2, BINS))
        for r in _scores(of[0].union(of[1]), fit_split(*halves)).groupBy("y", bin).count().collect():
            counts[r["y"], r["bin"]] = r["count"]
        priors.append(estimate_prior(counts[1], counts[0]))
    prior = float(np.mean(priors)) if priors else 0.5
    return Learnt(fit(p, u, prior), prior)


def scored(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", score: str = "quality_score",
           sample: int = SAMPLE_ROWS) -> DataFrame:
    """`documents` without `text`, with `score` (0 to 1, the probability of being good).

    Every row stays and whole texts are read. Null and empty texts are described by zeros and scored like others.
    Repeated rows get equal scores. A column that is already called like `score` is replaced; other names do not
    matter. With no trusted or no unlabelled text every score is `FLAT`.
    """
    names = [c for c in documents.columns if c not in (text, score)]
    rows = stored(described(documents, text, tuple(names)), "quality")
    found = learn(rows, labels, id, label, sample)
    return _scores(rows, found.model).select(*[F.col("rest").getField(c).alias(c) for c in names], F.col("score").alias(score))
