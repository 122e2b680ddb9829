"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its whole form and of its byte n-grams with word marks; unseen
misspellings share n-grams with known words. A passage of `WINDOW` words averages the
embeddings of all its subwords and a softmax over two classes judges the average. A text is
as toxic as its worst passage, so one insult in a very long text is not averaged away.
Labels are of whole texts. Training alternates: choose the worst passage of every text and
further passages of clean texts, then fit embeddings and softmax to them. The first choice
goes by smoothed log-odds of the subwords' text frequencies, later ones by the model.

Scores are linear before the softmax, so each subword adds one number to its passage; those
numbers are all that scoring needs, and running sums give every passage of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .tokens import Tokens, buffers, constants, mix, tokenize

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
WINDOW = 3
SAMPLE_ROWS = 6_000       # labelled texts to learn from, half of them toxic where there are enough
SAMPLE_BYTES = 48_000_000 # of these texts together, half for each class; no text is too long by itself up to that half
LEARN_BYTES = 1_000_000   # of text are split into words at a time
ROUNDS = 4
RATE = 0.05
PASSES = 3                # over the chosen passages, per round
LEAST_TEXTS = 3           # a subword of fewer training texts has no embedding: it would only be remembered
NEGATIVES = 24_000        # passages of clean texts a round
SLICE_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Model(NamedTuple):
    weight: np.ndarray    # float32 per bucket: (embedding) . (toxic - clean output vector)
    bias: float


def word_bytes(tokens: Tokens, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): all words with a mark before and after each, one after another."""
    offsets, raw = buffers(pc.fill_null(texts, ""))
    size = (tokens.end - tokens.start).astype(np.int64)
    padded = size + 2
    starts = np.cumsum(padded) - padded
    out = np.empty(int(padded.sum()), np.uint8)
    out[starts] = 60
    out[starts + size + 1] = 62
    source = tokens.start + offsets[tokens.row]
    shift = np.repeat(source - (starts + 1), size)
    at = np.arange(int(size.sum())) + np.repeat(starts + 1 - (np.cumsum(size) - size), size)
    out[at] = _LOWER[raw[at + shift]]
    return out, starts


def grams(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, bucket) of the n-grams of all words."""
    size = np.diff(np.r_[starts, len(data)])
    left = np.repeat(starts + size, size) - np.arange(len(data))
    place = np.flatnonzero(left >= n)
    c = constants(n, 100 + n)
    acc = np.zeros(len(place), np.uint64)
    for k in range(n):
        acc += data[place + k].astype(np.uint64) * c[k]
    word = np.searchsorted(starts, place, side="right") - 1
    return word, place, (mix(acc) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + np.uint64(99)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_sums(tokens: Tokens, texts: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: sum of its subwords' numbers, and how many subwords it has."""
    if not len(tokens.hash):
        return np.zeros(0), np.zeros(0)
    # a word that repeats within the slice is looked up once
    _, first, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
    distinct = Tokens(tokens.row[first], tokens.start[first], tokens.end[first], tokens.hash[first], tokens.bounds, tokens.lengths)
    data, starts = word_bytes(distinct, texts)
    total = weight[word_buckets(distinct.hash)].astype(np.float64)
    count = np.ones(len(first))
    for n in GRAMS:
        word, _, bucket = grams(data, starts, n)
        total += np.bincount(word, weight[bucket], minlength=len(first))
        count += np.bincount(word, minlength=len(first))
    return total[inverse], count[inverse]


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of all passages: every run of WINDOW words, or all words of a short text."""
    count = np.diff(bounds)
    number = np.where(count == 0, 0, np.maximum(1, count - WINDOW + 1))
    row = np.repeat(np.arange(len(count)), number)
    first = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + bounds[row]
    return row, first, np.minimum(first + WINDOW, bounds[row + 1])


def passage_scores(total: np.ndarray, count: np.ndarray, first: np.ndarray, end: np.ndarray, bias: float) -> np.ndarray:
    sums, counts = np.r_[0.0, np.cumsum(total)], np.r_[0.0, np.cumsum(count)]
    return bias + (sums[end] - sums[first]) / (counts[end] - counts[first])


def text_scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of each text; a text without words has that of an empty bag."""
    tokens = tokenize(texts)
    total, count = word_sums(tokens, texts, model.weight)
    row, first, end = passages(tokens.bounds)
    worst = np.full(len(texts), model.bias)
    if len(row):
        logit = passage_scores(total, count, first, end, model.bias)
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        worst[row[start]] = np.maximum.reduceat(logit, start)
    return 1.0 / (1.0 + np.exp(-np.clip(worst, -60, 60)))


def numbered(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, hashes, word, bounds): the distinct words of all texts in order of their hashes, as
    `word_bytes` has them; the number of the distinct word at every place, and the places of every text.

    Texts are read `LEARN_BYTES` at a time, so that only four bytes a word are held of all of them at the end.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(size) // LEARN_BYTES)) + 1
    known, pieces, sizes, fresh, places, counts = np.zeros(0, np.uint64), [], [], [], [], []
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)], strict=True):
        part = texts.slice(lo, hi - lo)
        part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
        tokens = tokenize(part)
        _, place = np.unique(tokens.hash, return_index=True)
        place = place[~np.isin(tokens.hash[place], known, assume_unique=True)]
        data, starts = word_bytes(Tokens(tokens.row[place], tokens.start[place], tokens.end[place], tokens.hash[place],
                                         tokens.bounds, tokens.lengths), part)
        pieces.append(data)
        sizes.append(np.diff(np.r_[starts, len(data)]))
        fresh.append(tokens.hash[place])
        known = np.union1d(known, fresh[-1])
        places.append(tokens.hash)
        counts.append(np.diff(tokens.bounds))
    order = np.argsort(np.concatenate(fresh))
    size = np.concatenate(sizes)
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    starts = np.cumsum(size) - size
    data = np.concatenate(pieces)[np.repeat(start - starts, size) + np.arange(int(size.sum()))]
    word = np.concatenate([np.searchsorted(known, h).astype(np.int32) for h in places])
    return data, starts, known, word, np.r_[0, np.cumsum(np.concatenate(counts))]


def blocks(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of texts of about `most` words, one text at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def fit(texts: pa.Array | pa.ChunkedArray, labels: np.ndarray, seed: int = 5) -> Model:
    """Learn embeddings and softmax from texts and labels (0, 1).

    With only one class, or no words, the score is that class's smoothed share everywhere.
    """
    positive, n = int(labels.sum()), len(labels)
    data, starts, distinct_hash, word_at, bounds = numbered(texts) if n and positive not in (0, n) else [np.zeros(0)] * 5
    if not len(word_at):
        share = (positive + 0.5) / (n + 1.0) if n else 0.1
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    # subwords of distinct word w: buckets[begin[w]:begin[w] + length[w]], the whole word first
    length = 1 + sum(np.maximum(0, np.diff(np.r_[starts, len(data)]) - k + 1) for k in GRAMS)
    begin = np.cumsum(length) - length
    buckets = np.empty(int(length.sum()), np.int32)
    buckets[begin] = word_buckets(distinct_hash)
    filled = np.ones(len(distinct_hash), np.int64)
    for k in GRAMS:
        for lo in range(0, len(distinct_hash), 20_000):               # some words at a time, for memory
            hi = min(len(distinct_hash), lo + 20_000)
            part = data[starts[lo]:starts[hi] if hi < len(distinct_hash) else len(data)]
            w, _, found = grams(part, starts[lo:hi] - starts[lo], k)
            number = np.bincount(w, minlength=hi - lo)
            within = np.arange(len(w)) - np.repeat(np.cumsum(number) - number, number)
            buckets[begin[lo:hi][w] + filled[lo:hi][w] + within] = found
            filled[lo:hi] += number

    # in how many toxic and clean texts each subword occurs; some texts at a time, for memory
    seen = np.zeros((2, BUCKETS), np.int64)
    for lo, hi in blocks(bounds, 50_000):
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
        text_of, word_of = np.divmod(np.unique(owner * len(distinct_hash) + word_at[bounds[lo]:bounds[hi]]), len(distinct_hash))
        size = length[word_of]
        spread = np.repeat(begin[word_of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(text_of, size) * BUCKETS + buckets[spread])
        for y in (0, 1):
            seen[y] += np.bincount(pairs[labels[lo + pairs // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    known = seen.sum(axis=0) >= LEAST_TEXTS
    odds = np.where(known, np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (n - positive + 1)), 0.0)
    flat = buckets[known[buckets]]                            # known subwords of word w: flat[edge[w]:edge[w + 1]]
    edge = np.r_[0, np.cumsum(np.add.reduceat(known[buckets], begin, dtype=np.int64))]
    del buckets

    embed = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    out = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)

    def step(bags: list[np.ndarray], target: np.ndarray, rate: float) -> None:
        """One gradient step on bags of word numbers."""
        nonlocal out, bias
        size = np.array([len(b) for b in bags])
        word = np.concatenate(bags)
        member = np.repeat(np.arange(len(bags)), size)
        count = np.bincount(member, length[word], minlength=len(bags))
        some = edge[word + 1] - edge[word]
        ids = flat[np.repeat(edge[word] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))]
        bag = np.repeat(member, some)
        mean = np.stack([np.bincount(bag, embed[ids, k], minlength=len(bags)) for k in range(DIM)], axis=1) / count[:, None]
        logit = mean @ out + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(bags)), target] -= 1
        d_mean, d_out, d_bias = p @ out.T, mean.T @ p, p.sum(axis=0)   # every subword gets its bag's gradient in full
        used, at = np.unique(ids, return_inverse=True)
        d_embed = np.stack([np.bincount(at, d_mean[bag, k], minlength=len(used)) for k in range(DIM)], axis=1)
        embed[used] -= rate * d_embed
        out = out - rate * d_out
        bias = bias - rate * d_bias

    def model() -> Model:
        weight = np.where(known, embed @ (out[:, 1] - out[:, 0]), 0.0)
        return Model(weight.astype(np.float32), float(bias[1] - bias[0]))

    # passages are numbered through all texts; those of text r begin at number[r] and at word bounds[r]
    count = np.diff(bounds)
    number = np.r_[0, np.cumsum(np.where(count == 0, 0, np.maximum(1, count - WINDOW + 1)))]
    clean = np.flatnonzero((labels == 0) & (count > 0))
    clean_number = np.r_[0, np.cumsum(np.diff(number)[clean])]
    weight, offset = odds, 0.0
    for _ in range(ROUNDS):
        sums = np.empty(len(distinct_hash))
        for lo in range(0, len(sums), 50_000):
            hi = min(len(sums), lo + 50_000)
            owner = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))
            sums[lo:hi] = np.bincount(owner, weight[flat[edge[lo]:edge[hi]]], minlength=hi - lo)
        top = []
        for lo, hi in blocks(bounds, 200_000):
            word = word_at[bounds[lo]:bounds[hi]]
            row, first, end = passages(bounds[lo:hi + 1] - bounds[lo])
            if len(row):
                logit = passage_scores(sums[word], length[word].astype(np.float64), first, end, offset)
                begin_row = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                best = np.maximum.reduceat(logit, begin_row)
                high = np.flatnonzero(logit == np.repeat(best, np.diff(np.r_[begin_row, len(row)])))
                top.append(number[lo] + high[np.r_[True, row[high][1:] != row[high][:-1]]])
        some = rng.choice(int(clean_number[-1]), min(NEGATIVES, int(clean_number[-1])), replace=False)
        of = np.searchsorted(clean_number, some, side="right") - 1
        some = some - clean_number[of] + number[clean[of]]
        top = np.concatenate(top)
        chosen = np.unique(np.r_[top, some])
        bad = chosen[labels[np.searchsorted(number, chosen, side="right") - 1] == 1]   # repeated, so that about a quarter is toxic
        chosen = np.r_[chosen, np.repeat(bad, max(0, len(chosen) // max(1, 3 * len(bad)) - 1))]
        row = np.searchsorted(number, chosen, side="right") - 1
        first = bounds[row] + chosen - number[row]
        end = np.minimum(first + WINDOW, bounds[row + 1])
        for _ in range(PASSES):
            mixed = rng.permutation(len(chosen))
            for lo in range(0, len(mixed), 128):
                pick = mixed[lo:lo + 128]
                step([word_at[first[i]:end[i]] for i in pick], labels[row[pick]], RATE)
        weight, offset = model()
    return model()


def training_rows(documents: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int, max_bytes: int) -> DataFrame:
    """At most `rows` labelled texts of `max_bytes` together outside the held-out fifth, half of each for each class.

    Ids are chosen by their hash, among those that have a text of a length that fits at all, until the
    class has its rows or its bytes; a text with several labels takes the largest.
    """
    marked = labels.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(
        "id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.where(~held_out(F.col("id")))
    texts = documents.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    sized = texts.select("id", F.octet_length("text").cast("long").alias("bytes")).groupBy("id").agg(F.sum("bytes").alias("bytes"))
    sized = marked.join(sized.where(F.col("bytes") <= max_bytes // 2), "id")
    order = [F.xxhash64("id"), F.col("id")]
    per_class = [sized.where(F.col("y") == y).orderBy(*order).limit(rows // 2) for y in (0, 1)]
    # at most `rows` rows of three numbers
    chosen = per_class[0].union(per_class[1]).withColumn("total", F.sum("bytes").over(
        Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return texts.join(F.broadcast(chosen.where(F.col("total") <= max_bytes // 2).select("id", "y")), "id")


def held_out(id: Column) -> Column:
    """Whether a document is never learnt from."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit a model on the bounded sample of `training_rows`. Repeated ids may add a few rows; they are cut by order."""
    found = training_rows(documents, labels, id, text, label, rows, max_bytes).orderBy("id", F.xxhash64("text")).limit(2 * rows).toArrow()
    return fit(found["text"], found["y"].to_numpy().astype(np.int64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                score = text_scores(batch.column("text"), model)
                yield pa.RecordBatch.from_pydict({"rest": batch.column("rest"), "text": batch.column("text"), "score": pa.array(score)})
    return run


def scored(documents: DataFrame, model: Model, text: str = "text", score: str = "toxicity") -> DataFrame:
    """`documents` with the column `score` (0 to 1). Every row stays, whole texts are read.

    Null and empty texts get the score of an empty bag. Columns may have any names; one that
    is already called like `score` is replaced.
    """
    names = [c for c in documents.columns if c != score]
    body = documents.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text] or [F.lit(None).cast("int")]).alias("rest"),
                            F.col(f"`{text}`").alias("text"))
    schema = T.StructType([body.schema["rest"], T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])
    out = body.mapInArrow(_score(model), schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in names],
                      F.col("score").alias(score))
