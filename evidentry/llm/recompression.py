"""A run-length grammar of a sequence by recompression, and longest common extensions on it.

Levels alternate between two steps. Block compression replaces every maximal block of two or
more equal symbols by one symbol for (symbol, length). Pair compression deals the alphabet into
a left and a right half and replaces every left symbol followed by a right one by one symbol for
the pair. Both look at neighbours only, so equal stretches get equal symbols but for a symbol or
a block at their ends. That is why an extension climbs while symbols are equal, reading at most
one symbol or block a level, and descends the same way from the first difference.

Everything is done for many sequences and many queries at once: sequences lie one after
another, each closed by a symbol of its own that never takes part in a step, so no extension
crosses it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .tokens import mix

FEW_SYMBOLS = 8      # sequences of the top level have so many symbols at most, unless ROUNDS end first
ROUNDS = 120         # the rest is read symbol by symbol on the top level, which is exact as well


class Level(NamedTuple):
    symbol: np.ndarray           # int32 symbols of this level
    start: np.ndarray | None     # first symbol on the level below, with one more entry at the end
    parent: np.ndarray | None    # symbol of the level above that holds a symbol
    block: bool                  # made from the level below by blocks (else by pairs)


class Grammar(NamedTuple):
    levels: list[Level]


def _numbered(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Equal keys get equal new symbols from `first` on."""
    _, inverse = np.unique(keys, return_inverse=True)
    return (inverse + first).astype(np.int32), first + (int(inverse.max()) + 1 if len(inverse) else 0)


def _shrunk(symbol: np.ndarray, starts: np.ndarray, replaced: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = symbol[starts]
    out[replaced] = names
    return out


def build(sequence: np.ndarray, closing: np.ndarray) -> Grammar:
    """Grammar of int32 symbols 0, 1, ...; `closing` marks the places of the closing symbols."""
    symbol = sequence.astype(np.int32)
    fresh = int(symbol.max()) + 1 if len(symbol) else 0
    shut = closing
    levels = [Level(symbol, None, None, False)]

    def push(starts: np.ndarray, made: np.ndarray, block: bool) -> None:
        nonlocal symbol, shut
        parent = np.zeros(len(symbol), np.int32)
        parent[starts[1:]] = 1
        levels[-1] = levels[-1]._replace(parent=np.cumsum(parent, dtype=np.int32))
        levels.append(Level(made, np.r_[starts, len(symbol)].astype(np.int32), None, block))
        shut = shut[starts]
        symbol = made

    for round_ in range(ROUNDS):
        ends = np.flatnonzero(shut)
        if not len(ends) or int(np.diff(np.r_[-1, ends]).max()) - 1 <= FEW_SYMBOLS:
            break
        same = symbol[1:] == symbol[:-1]
        if same.any():
            starts = np.flatnonzero(np.r_[True, ~same])
            size = np.diff(np.r_[starts, len(symbol)])
            many = np.flatnonzero(size > 1)
            names, fresh = _numbered(symbol[starts[many]].astype(np.int64) << 32 | size[many], fresh)
            push(starts, _shrunk(symbol, starts, many, names), True)
        # a symbol's half is a hash of it and the round; the halves change places where that gives more pairs
        right = (mix(symbol.astype(np.uint64) + np.uint64(fresh) * np.uint64(round_ + 1)) & np.uint64(1)).astype(bool)
        inner = ~shut[1:] & ~shut[:-1]
        rising, falling = inner & ~right[:-1] & right[1:], inner & right[:-1] & ~right[1:]
        heads = np.flatnonzero(rising if rising.sum() >= falling.sum() else falling)
        if not len(heads):
            continue
        first = np.ones(len(symbol), bool)
        first[heads + 1] = False
        starts = np.flatnonzero(first)
        names, fresh = _numbered(symbol[heads].astype(np.int64) << 32 | symbol[heads + 1], fresh)
        push(starts, _shrunk(symbol, starts, np.searchsorted(starts, heads), names), False)
    return Grammar(levels)


def _extension(grammar: Grammar, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from places `left` and `right` on agree, to the right (step 1) or to the left (step -1)."""
    levels = grammar.levels
    a, b = left.astype(np.int64), right.astype(np.int64)
    stopped = np.full(len(a), -1, np.int32)          # level of the first difference
    live = np.arange(len(a))

    def at(level: Level, x: np.ndarray) -> np.ndarray:
        """Symbols at x; beyond the edges there is a symbol that equals nothing."""
        out = level.symbol[np.clip(x, 0, len(level.symbol) - 1)]
        return np.where((x < 0) | (x >= len(level.symbol)), -1, out)

    def differ(level: Level, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = at(level, x)
        return (s != at(level, y)) | (s < 0)

    def rest(up: Level, level: Level, x: np.ndarray) -> np.ndarray:
        """Symbols from x to the edge of the symbol above that holds it, in the direction of the step."""
        p = level.parent[x]
        return up.start[p + 1] - x if step > 0 else x - up.start[p] + 1

    for depth, level in enumerate(levels):
        off = differ(level, a[live], b[live])
        stopped[live[off]] = depth
        live = live[~off]
        if not len(live):
            break
        if depth + 1 == len(levels):
            while len(live):                         # no level above: symbol by symbol
                a[live] += step
                b[live] += step
                off = differ(level, a[live], b[live])
                stopped[live[off]] = depth
                live = live[~off]
            break
        up = levels[depth + 1]
        x, y = a[live], b[live]
        p, q = level.parent[x], level.parent[y]
        if step > 0:
            inside = (up.start[p] != x) | (up.start[q] != y)
        else:
            inside = (up.start[p + 1] - 1 != x) | (up.start[q + 1] - 1 != y)
        few = np.flatnonzero(inside)
        if len(few):
            x, y = x[few], y[few]
            m, n = rest(up, level, x), rest(up, level, y)
            if not up.block:                         # equal symbols are both first or both second of pairs
                m = n = np.ones(len(few), np.int64)
            least = np.minimum(m, n)
            a[live[few]], b[live[few]] = x + step * least, y + step * least
            if up.block:
                stopped[live[few[m != n]]] = depth   # the shorter block is followed by another symbol
                live = live[~np.isin(np.arange(len(live)), few[m != n])]
        # places beyond the edges have no symbol above
        gone = (a[live] < 0) | (a[live] >= len(level.symbol)) | (b[live] < 0) | (b[live] >= len(level.symbol))
        stopped[live[gone]] = depth
        live = live[~gone]
        a[live], b[live] = level.parent[a[live]], level.parent[b[live]]

    for depth in range(int(stopped.max(initial=0)), 0, -1):
        level, below = levels[depth], levels[depth - 1]
        down = np.flatnonzero(stopped >= depth)
        x, y = a[down], b[down]
        if step > 0:
            x, y = level.start[np.clip(x, 0, len(level.symbol))].astype(np.int64), level.start[np.clip(y, 0, len(level.symbol))].astype(np.int64)
        else:
            x, y = level.start[np.clip(x + 1, 0, len(level.symbol))].astype(np.int64) - 1, level.start[np.clip(y + 1, 0, len(level.symbol))].astype(np.int64) - 1
        on = np.flatnonzero(~differ(below, x, y))    # the first parts agree; then one block or one symbol does
        if len(on):
            if level.block:
                least = np.minimum(rest(level, below, x[on]), rest(level, below, y[on]))
            else:
                least = np.ones(len(on), np.int64)
            x[on] += step * least
            y[on] += step * least
        a[down], b[down] = x, y
    return a - left if step > 0 else left - a


def forward(grammar: Grammar, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common extension: agreeing symbols from `left` and `right` (left < right) on."""
    return _extension(grammar, left, right, 1)


def backward(grammar: Grammar, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Agreeing symbols that end at `left` and `right`, both included."""
    return _extension(grammar, left, right, -1)
