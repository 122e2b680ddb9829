"""Words of whole texts as arrays: byte places and 64-bit hashes, computed in numpy.

Texts are lower-cased in A-Z. The hash of a word is a polynomial of its bytes, taken from a
running sum, so the cost is a few array operations per byte and no Python object per word.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 500_000
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 2**64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


class Tokens(NamedTuple):
    row: np.ndarray      # row of each word
    start: np.ndarray    # byte offset of each word within its row's text
    end: np.ndarray
    hash: np.ndarray     # uint64
    bounds: np.ndarray   # words of row r are bounds[r] .. bounds[r + 1]
    lengths: np.ndarray  # bytes of each row


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def constants(n: int, seed: int) -> np.ndarray:
    """n odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_PRIME) + np.uint64(seed)) | np.uint64(1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def tokenize(texts: pa.Array) -> Tokens:
    """Words of all rows. Long texts are read in pieces cut between words."""
    import pyarrow.compute as pc

    offsets, raw = buffers(pc.fill_null(texts, ""))
    first, last = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    lo = first
    while lo < last:
        hi = min(lo + PIECE, last)
        while hi < last and not _SEPARATOR[raw[hi - 1]]:   # go on to the next separator
            ahead = np.flatnonzero(_SEPARATOR[raw[hi:min(hi + 4096, last)]])
            hi = hi + int(ahead[0]) + 1 if len(ahead) else min(hi + 4096, last)
        piece = _LOWER[raw[lo:hi]]
        inside = ~_SEPARATOR[piece]
        edge = np.zeros(len(piece) + 1, bool)
        rows = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, side="right")] - lo
        edge[rows[rows <= len(piece)]] = True                 # a text begins here: no word crosses it
        before = np.r_[False, inside[:-1]]
        after = np.r_[inside[1:], False]
        s = np.flatnonzero(inside & (~before | edge[:-1]))
        e = np.flatnonzero(inside & (~after | edge[1:])) + 1
        # a power table is kept for the usual length only
        n = PIECE + 65_536 if len(piece) <= PIECE + 65_536 else len(piece)
        running = np.r_[np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers(n, _PRIME)[:len(piece)])]
        value = (running[e] - running[s]) * _powers(n, _INVERSE)[s]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(value + (e - s).astype(np.uint64)))
        lo = hi
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    hash_ = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    row = np.searchsorted(offsets, start, side="right") - 1
    bounds = np.searchsorted(start, offsets)
    return Tokens(row, start - offsets[row], end - offsets[row], hash_, bounds, np.diff(offsets))


def shingles(tokens: Tokens, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(place of first word, hash) of every run of `n` words within a row.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    h, c = tokens.hash, constants(n, seed)
    total = len(h)
    count = np.diff(tokens.bounds)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        acc[:max(0, total - k)] += h[k:] * c[k]
    acc = mix(acc)
    left = tokens.bounds[1:][tokens.row] - np.arange(total)   # words from here to the end of the row
    keep = left >= n
    short = np.flatnonzero((count > 0) & (count < n))
    for r in short:
        lo, hi = tokens.bounds[r], tokens.bounds[r + 1]
        acc[lo] = mix(np.sum(h[lo:hi] * c[:hi - lo], dtype=np.uint64, keepdims=True) + np.uint64(n - (hi - lo)))[0]
        keep[lo] = True
    place = np.flatnonzero(keep)
    return place, acc[place]
