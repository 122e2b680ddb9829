"""Chat formatting by columnar byte assembly.

The turns of a batch are five byte segments each: opening mark, role, separator, text,
closing mark. Segment lengths and their cumulative sum give every segment's place in one
preallocated buffer; scatter indices copy all roles and all texts into it at once. Slices
of that buffer are the rows of the output, so no Python string is built per turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices

#: The template. A turn is <s>[ROLE]role[/ROLE]text</s>.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
#: Control strings of this and of common instruction templates, with any escapes already in them.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\]))"
TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.DOTALL)

SLICE_BYTES = 4_000_000
LONG_SEGMENT = 65_536

FORMATTED = ("conv_id long, part long, n_turns long, formatted string, "
             "loss_spans array<struct<start:long,end:long>>")


def escape(values: pa.Array) -> pa.Array:
    """Put one backslash more after the first character of every control string."""
    return pc.replace_substring_regex(values, CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def _scatter(out: np.ndarray, starts: np.ndarray, values: pa.Array) -> None:
    """Copy every value to its start in `out`."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    size = np.diff(offsets)
    if data is None or not size.any():
        return
    source = np.frombuffer(data, np.uint8)
    for i in np.flatnonzero(size > LONG_SEGMENT):  # an index per byte would be eight times the text
        out[starts[i]:starts[i] + size[i]] = source[offsets[i]:offsets[i + 1]]
    short = np.where(size > LONG_SEGMENT, 0, size)
    total = int(short.sum())
    within = np.arange(total) - np.repeat(np.cumsum(short) - short, short)
    out[np.repeat(starts, short) + within] = source[np.repeat(offsets[:-1], short) + within]


def _constant(out: np.ndarray, starts: np.ndarray, text: str) -> None:
    raw = np.frombuffer(text.encode(), np.uint8)
    out[starts[:, None] + np.arange(len(raw))] = raw


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, spoken: np.ndarray):
    """Formatted pieces of consecutive turns: (first row of each piece, texts, loss spans)."""
    n = len(conv)
    role, text = escape(role.cast(pa.large_string())), escape(text.cast(pa.large_string()))
    size, points = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, mark in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        size[:, k] = points[:, k] = len(mark)
    for k, values in ((1, role), (3, text)):
        size[:, k] = np.asarray(pc.binary_length(values))
        points[:, k] = np.asarray(pc.utf8_length(values))
    ends = np.cumsum(size.ravel()).reshape(n, 5)
    starts = ends - size
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, mark in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        _constant(out, starts[:, k], mark)
    _scatter(out, starts[:, 1], role)
    _scatter(out, starts[:, 3], text)

    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    bounds = np.r_[starts[first, 0], ends[-1, -1]].astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    place = np.cumsum(points.ravel()).reshape(n, 5) - points
    piece = np.searchsorted(first, np.arange(n), side="right") - 1
    begin = (place[:, 3] - place[first, 0][piece])[spoken]
    count = np.bincount(piece[spoken], minlength=len(first))
    spans = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + points[spoken, 3])], ["start", "end"]))
    return first, texts, spans


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            ids = batch.column("conv_id")
            valid = np.asarray(ids.is_valid())
            key = np.where(valid, np.asarray(pc.fill_null(ids, 0)), 0)
            change = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])])
            role, text = (pc.fill_null(batch.column(c), "") for c in ("role", "text"))
            spoken = np.asarray(pc.equal(role, "assistant"))
            first, texts, spans = assemble(change, role, text, spoken)
            turns = np.diff(np.r_[first, batch.num_rows]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(turns),
                 texts.cast(pa.string()), spans],
                names=["conv_id", "part", "n_turns", "formatted", "loss_spans"])
            part += len(first)


def format_chats(turns: DataFrame) -> DataFrame:
    """Format `turns(conv_id, turn, role, text)`; other columns are ignored.

    One row per piece: conv_id, part, n_turns, formatted, loss_spans (code points of every
    assistant text within the piece). Most conversations are one piece. Turns are ordered by
    turn (null first), then role, then a hash of the text, then the text; equal rows all stay.
    Rows are dealt by range of that order, so a conversation with a third of all rows spans
    many tasks; its pieces are consecutive in `part` and concatenate to the whole. Null role
    and text count as empty, rows with a null conv_id form one conversation. An empty table
    gives no rows.
    """
    n = partitions(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("h"),
                        F.monotonically_increasing_id().alias("row"))
    return (rows.repartitionByRange(n, "conv_id", "turn", "role", "h", "row")
            .sortWithinPartitions("conv_id", "turn", "role", "h", "text")
            .select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(_format, FORMATTED))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted piece."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations of one partition, whose pieces come in order.

    The state between pieces is two running digests and three counters.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    current, state = None, None

    def close() -> tuple:
        n, turns, chars, loss, points = state
        return current[0], n, turns.hexdigest(), chars, loss.hexdigest(), points

    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "formatted", "loss_spans")]
        for i in range(batch.num_rows):
            conv, formatted, spans = (c[i].as_py() for c in columns)
            if current != (conv,):
                if current is not None:
                    done.append(close())
                current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = unescape(formatted[span["start"]:span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if len(done) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done = []
    if current is not None:
        done.append(close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def chat_digests(pieces: DataFrame) -> DataFrame:
    """Digests per conversation, read back from formatted pieces.

    A digest of a whole conversation is sequential by definition, so the pieces of one
    conversation are read by one task; it streams them and holds one batch at a time.
    """
    n = partitions(pieces.sparkSession)
    return (pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
            .select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, DIGESTS))
