"""Periodic runs of words: stretches that repeat a short sequence at least `exponent` times.

A run of period q and length L has L - q words in a row that equal the word q places on, and at
least s = max(least, exponent * q) - q of them. Places 0, s, 2s, ..., the harmonic grid of q,
therefore hit every run, and a text of n words has about n / (exponent - 1) * ln(n) of them for
all q. Where the words at a grid place and q places on agree, two longest-common-extension
queries on the grammar of `recompression.py` give the exact run. A stretch with several periods
is found with all of them (the smallest divides the others) and keeps the smallest.

Texts of an Arrow batch are joined up to `SLICE_WORDS` words (one text at least) and share a
grammar: memory is bounded by a slice or by the longest text. Nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import recompression

LEAST_WORDS = 6
EXPONENT = 4
SLICE_WORDS = 250_000
GRID_PLACES = 1_000_000   # looked at together

_FIELDS = ("start", "length", "period")
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in _FIELDS]), False)
_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in _FIELDS])


def _grid(first: np.ndarray, count: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grids of sequences that begin at `first` and have `count` symbols, some at a time."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    period = np.arange(1, int(count[0]) // exponent + 1 if len(count) else 1)
    need = np.maximum(least, exponent * period)
    step = need - period
    able = np.searchsorted(-count, -need, side="right")      # so many sequences are long enough
    places = np.r_[0, np.cumsum(count)][able] // step + able
    chunk = np.cumsum(places) // GRID_PLACES
    for c in np.unique(chunk):
        some = np.flatnonzero((chunk == c) & (able > 0))
        if not len(some):
            continue
        which = np.repeat(some, able[some])
        member = np.arange(len(which)) - np.repeat(np.cumsum(able[some]) - able[some], able[some])
        number = (count[member] - period[which] - 1) // step[which] + 1
        line = np.repeat(np.arange(len(which)), number)
        turn = np.arange(len(line)) - np.repeat(np.cumsum(number) - number, number)
        yield first[member[line]] + turn * step[which[line]], period[which[line]]


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    Words are numbers from 0 on, equal for equal words; those of text t lie at bounds[t] .. bounds[t + 1].
    `exponent` is 2 at least.
    """
    count = np.diff(bounds)
    texts = len(count)
    # every text is closed by a symbol of its own
    place = np.arange(len(words)) + np.repeat(np.arange(texts), count)
    joined = np.zeros(len(words) + texts, np.int32)
    joined[place] = words
    shut = np.zeros(len(joined), bool)
    shut[bounds[1:] + np.arange(texts)] = True
    joined[shut] = (int(words.max()) + 1 if len(words) else 0) + np.arange(texts)
    begin = bounds[:-1] + np.arange(texts)
    grammar, found = None, []
    for at, period in _grid(begin, count, least, exponent):
        same = joined[at] == joined[at + period]
        at, period = at[same], period[same]
        if not len(at):
            continue
        if grammar is None:
            grammar = recompression.build(joined, shut)
        ahead = recompression.forward(grammar, at, at + period)
        back = recompression.backward(grammar, at, at + period)
        length = ahead + back - 1 + period
        long = length >= np.maximum(least, exponent * period)
        found.append(np.stack([at[long] - back[long] + 1, length[long], period[long]], axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # of equal stretches the first row has the smallest period
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
    text = np.searchsorted(begin, rows[:, 0], side="right") - 1
    rows = np.c_[text, rows[:, 0] - begin[text], rows[:, 1], rows[:, 2]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _slice(texts: list[str | None], least: int, exponent: int) -> tuple[pa.Array, list[str]]:
    """Runs and the collapsed text of every text. ASCII blanks part words, as `bytes.split` has it."""
    split = [t.encode("utf-8").split() if t else [] for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    bounds = np.r_[0, np.cumsum(count)]
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    words = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int32, int(bounds[-1]))
    rows = runs_of(words, bounds, least, exponent)
    # words that a run holds after its first period
    edges = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(edges, bounds[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(edges, bounds[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    kept = np.cumsum(edges[:-1]) == 0
    some = set(rows[:, 0].tolist())
    collapsed = [b" ".join([w for w, k in zip(t, kept[bounds[i]:bounds[i + 1]].tolist(), strict=True) if k] if i in some else t)
                 .decode("utf-8") for i, t in enumerate(split)]
    per_text = np.r_[0, np.cumsum(np.bincount(rows[:, 0], minlength=len(texts)))]
    runs = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()),
                                    pa.StructArray.from_arrays([pa.array(rows[:, k + 1], pa.int64()) for k in range(3)],
                                                               fields=list(_RUN)))
    return runs, collapsed


def _cut(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about `most` words, taken as six bytes each, one row at least."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64) // 6 + 1
    edges = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    if len(values):
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)


def _run(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _cut(batch.column("text"), SLICE_WORDS):
                part = batch.slice(lo, hi - lo)
                runs, collapsed = _slice(part.column("text").to_pylist(), least, exponent)
                yield pa.RecordBatch.from_pydict({"rest": part.column("rest"), "runs": runs, "collapsed": pa.array(collapsed, pa.string())})
    return run


def periodic_runs(documents: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
                  least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """`documents` without `text`, with `runs` (array of start, length, period in words, by start and period) and `collapsed`.

    A run is a stretch of words with smallest period q and a length of at least `least` and `exponent` * q
    (`exponent` >= 2) that no neighbouring word extends. `collapsed` joins by one blank the words that no run
    holds after its first q words. Words are parted by ASCII blanks and compared byte by byte.

    Null, empty and blank texts have no runs and an empty `collapsed`. Every row stays, repeated rows too; whole
    texts are read; other columns pass, but those called like the new ones are replaced.
    """
    names = [c for c in documents.columns if c not in (text, runs, collapsed)]
    body = documents.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(None).cast("int")]).alias("rest"),
                            F.col(f"`{text}`").alias("text"))
    schema = T.StructType([body.schema["rest"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    out = body.mapInArrow(_run(least, exponent), schema)
    return out.select(*[F.col("rest").getField(c).alias(c) for c in names], F.col("runs").alias(runs),
                      F.col("collapsed").alias(collapsed))
