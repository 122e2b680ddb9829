"""Substring deduplication by hashed units with their offsets.

Units of a text are its lines of at least `LINE_WORDS` words and, since passages also repeat
inside lines, runs of `RUN` words that start at content-defined places. Such places are the
least hashes of any `WINNOW` neighbouring runs, so two texts that share RUN + WINNOW - 1
words or more share a unit, and the units of a shared passage overlap without gaps. Words
are lower-cased in A-Z and blanks do not matter. Equal units are grouped globally; the
earliest occurrence (document id, text, place) stays, all others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters
from .common import frequent, slices, stored
from .tokens import Tokens, buffers, constants, mix, tokenize

RUN, WINNOW = 12, 9
LINE_WORDS = 5
PASSAGE_WORDS = 25       # shorter repeated passages inside lines stay
SLICE_BYTES = 1_000_000
LINE, PASSAGE = 0, 1


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[i .. i + width - 1]; shorter at the end."""
    out = values.copy()
    for k in range(1, width):
        out[:-k] = best(out[:-k], values[k:]) if k < len(values) else out[:-k]
    return out


def _hashes(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    c, out = constants(n, seed), np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out += h[k:len(h) - n + 1 + k] * c[k]
    return mix(out)


def passage_units(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the chosen runs of one text with word hashes `h`."""
    if len(h) < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = _hashes(h, RUN, 3)
    width = min(WINNOW, len(runs))
    least = _sliding(runs, width, np.minimum)[:len(runs) - width + 1]   # of every full window
    highest = _sliding(least[::-1], width, np.maximum)[::-1]            # over windows that end at most here
    top = np.full(len(runs), 0, np.uint64)
    top[:len(highest)] = highest
    if width > 1:                                                      # runs after the last window's start
        tail = np.arange(len(highest), len(runs))
        for i in tail:
            top[i] = least[max(0, i - width + 1):].max()
    place = np.flatnonzero(runs == top)
    return place, runs[place]


def line_numbers(tokens: Tokens, texts: pa.Array) -> np.ndarray:
    """Number of the line of every word, counted over the batch and never shared by two rows."""
    offsets, raw = buffers(pc.fill_null(texts, ""))
    feeds = np.flatnonzero(raw[offsets[0]:offsets[-1]] == 10) + offsets[0]
    at = tokens.start + offsets[tokens.row]
    return np.searchsorted(feeds, at) + tokens.row


def units(tokens: Tokens, texts: pa.Array):
    """(row, kind, first word, words, hash, second hash) of all units, as arrays; words count within the row."""
    h, second = tokens.hash, mix(tokens.hash + np.uint64(0x1234567))
    rows, kinds, firsts, counts, ones, twos = [], [], [], [], [], []
    if len(h):
        line = line_numbers(tokens, texts)
        start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        size = np.diff(np.r_[start, len(h)])
        within = np.arange(len(h)) - np.repeat(start, size)
        # order matters: every word hash is mixed with its place in the line
        place = mix(within.astype(np.uint64) + np.uint64(77)) | np.uint64(1)
        one = mix(np.add.reduceat(h * place, start) + size.astype(np.uint64))
        two = mix(np.add.reduceat(second * place, start) + size.astype(np.uint64))
        long = size >= LINE_WORDS
        rows.append(tokens.row[start[long]])
        kinds.append(np.full(long.sum(), LINE, np.int64))
        firsts.append(start[long] - tokens.bounds[tokens.row[start[long]]])
        counts.append(size[long])
        ones.append(one[long])
        twos.append(two[long])
    for r in range(len(tokens.bounds) - 1):
        lo, hi = tokens.bounds[r], tokens.bounds[r + 1]
        place, value = passage_units(h[lo:hi])
        if len(place):
            c = constants(RUN, 5)
            two = np.zeros(len(place), np.uint64)
            for k in range(RUN):
                two += second[lo + place + k] * c[k]
            rows.append(np.full(len(place), r))
            kinds.append(np.full(len(place), PASSAGE, np.int64))
            firsts.append(place)
            counts.append(np.full(len(place), RUN))
            ones.append(value)
            twos.append(mix(two))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in (rows, kinds, firsts, counts, ones, twos))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            texts = batch.column("text")
            _, kind, _, _, one, _ = units(tokenize(texts), texts)
            # copies within the slice come out once with their number
            value, count = np.unique(one + kind.astype(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["h", "n"])


#: place: number of the first word, doubled, and one more for lines
UNITS = "id long, text_key long, place long, digest_a long, digest_b long"


def _suspects(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = batch.column("text")
                row, kind, first, _, one, two = units(tokenize(texts), texts)
                one = one + kind.astype(np.uint64)
                may = filters.contains(known, one)
                take = pa.array(row[may], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("text_key").take(take), pa.array(2 * first[may] + (kind[may] == LINE)),
                     pa.array(one[may].view(np.int64)), pa.array(two[may].view(np.int64))],
                    names=["id", "text_key", "place", "digest_a", "digest_b"])
    return run


def removed_words(n: int, later: np.ndarray, earliest: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges to remove from a text of n words.

    later, earliest: (first, words) of its repeated units of which an earlier occurrence
    exists, or which are the earliest; negative words mark lines. A word goes if a later unit
    holds it and no earliest one does; passages inside lines go if they are long enough.
    """
    def cover(parts: np.ndarray) -> np.ndarray:
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, parts[:, 0], 1)
        np.add.at(step, parts[:, 0] + np.abs(parts[:, 1]), -1)
        return np.cumsum(step)[:n] > 0

    def ranges(mask: np.ndarray) -> list[tuple[int, int]]:
        edge = np.diff(np.r_[False, mask, False].astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))

    lines, inner = later[later[:, 1] < 0], later[later[:, 1] > 0]
    mine = earliest[earliest[:, 1] > 0]
    passages = cover(inner) & ~cover(mine)
    keep = np.zeros(n, bool)
    for lo, hi in ranges(passages):
        keep[lo:hi] = hi - lo >= PASSAGE_WORDS
    return ranges(keep | cover(lines))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", SLICE_BYTES)):
        names = batch.schema.names
        texts, marks = batch.column("text"), batch.column("marks")
        out_text, spans = [], []
        for i in range(batch.num_rows):
            found = marks[i].as_py() if marks[i].is_valid else None
            text = texts[i].as_py()
            if not found or text is None:
                out_text.append(text)
                spans.append([])
                continue
            tokens = tokenize(texts.slice(i, 1))
            mark = np.array(found, np.int64)
            first, is_line, later = mark >> 2, mark & 2 > 0, mark & 1 > 0
            line = line_numbers(tokens, texts.slice(i, 1))
            words = np.where(is_line, first - np.searchsorted(line, line[first], side="right"), RUN)   # lines negative
            table = np.stack([first, words], axis=1)
            gone = removed_words(len(tokens.hash), table[later], table[~later])
            raw = text.encode()
            # byte offset -> code point offset
            points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
            pieces, at, mine = [], 0, []
            for lo, hi in gone:
                s, e = int(tokens.start[lo]), int(tokens.end[hi - 1])
                whole = (s == 0 or raw[s - 1:s] == b"\n") and (e == len(raw) or raw[e:e + 1] == b"\n")
                if whole and e < len(raw):
                    e += 1                              # the line goes with its end
                elif e < len(raw) and raw[e:e + 1] == b" ":
                    e += 1                              # so that no two blanks meet
                mine.append({"start": int(points[s]), "end": int(points[e]), "words": hi - lo})
                pieces.append(raw[at:s])
                at = e
            pieces.append(raw[at:])
            out_text.append(b"".join(pieces).decode())
            spans.append(mine)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
        columns = {c: batch.column(c) for c in names if c not in ("text", "marks")}
        yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(out_text, pa.string()), "removed": pa.array(spans, kind)})


def repeated_units(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_key, mark) of all units that occur more than once.

    mark = 4 * number of the first word + 2 for lines + 1 for all but the earliest occurrence.
    The first pass only counts unit hashes; what cannot repeat is dropped by a filter of fixed
    size before units are grouped exactly. Rows of a frequent unit stay where they are and get
    its earliest occurrence by a broadcast; only rows of all other units are shuffled.
    """
    source = documents.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    source = source.select("id", "text", F.xxhash64("text").alias("text_key"))
    counts = stored(source.select("text").mapInArrow(_digests, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "counts")
    known = filters.build(counts, "h")
    suspects = stored(source.mapInArrow(_suspects(known), UNITS), "units")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", F.shiftright("place", 1).alias("first"))
    keys = ["digest_a", "digest_b"]

    def earliest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1").select(*keys, "best")

    hot = F.broadcast(frequent(counts).select(F.col("h").alias("digest_a")))
    many, few = suspects.join(hot, "digest_a", "left_semi"), suspects.join(hot, "digest_a", "left_anti")
    found = many.join(F.broadcast(earliest(many)), keys).unionByName(few.join(earliest(few), keys))
    return found.select("id", "text_key", (F.col("place") * 2 + (rank != F.col("best")).cast("int")).alias("mark"))


def deduplicated(documents: DataFrame, id: str = "doc_id", text: str = "text", removed: str | None = "removed") -> DataFrame:
    """`documents` with repeated units cut out of `text`; `removed` has the spans cut.

    Spans are {start, end, words} in code points of the original text, so original = text
    with the spans put back. All rows stay, also those whose text becomes empty; null and
    empty texts are returned as they are. Rows that repeat in id and text are one document
    and get the same result. A null id ranks last. Other columns pass through; `removed` None
    leaves the spans out. A column that is already called like `removed` is replaced.
    """
    names = [c for c in documents.columns if c != removed]
    marks = repeated_units(documents, id, text).groupBy("id", "text_key").agg(
        F.collect_set("mark").alias("marks"), F.bit_or("mark").alias("any"))
    marks = marks.where("any % 2 = 1").select(F.col("id").alias("m_id"), F.col("text_key").alias("m_key"), "marks")
    body = documents.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("key"),
                            F.col(f"`{id}`").cast("long").alias("id"),
                            F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("rest"))
    joined = body.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    joined = joined.select("rest", "text", "marks")
    schema = T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField(
        "removed", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "words")])))])
    cut = joined.mapInArrow(_cut, schema)
    columns = [F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in names]
    return cut.select(*columns, *([F.col("removed").alias(removed)] if removed else []))
