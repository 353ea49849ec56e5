"""Levels of whole grids of values at once, in numpy: the same as those of the column functions.

Texts are compared by bit-parallel edit distance (Myers, 1999; Hyyrö, 2003): a text's characters are the bits of a
word, and one step of all rows against all columns is a few operations on arrays of such words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Texts:
    """Texts as code points, nulls apart."""

    def __init__(self, values: list[str | None]):
        self.null = np.array([v is None for v in values], dtype=bool)
        self.length = np.array([0 if v is None else len(v) for v in values], dtype=np.int64)
        wide = int(self.length.max(initial=0))
        self.chars = np.array([v or "" for v in values], dtype=f"U{max(wide, 1)}").view(np.uint32).reshape(len(values), max(wide, 1))
        self.known, self.at, self.kept = np.unique(self.chars), None, {}

    def runs(self) -> list[tuple[int, tuple[int, int]]]:
        """(length, (first, end)) of neighbours of one length, nulls left out."""
        key = np.where(self.null, -1, self.length)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        return [(int(key[i]), (i, j)) for i, j in zip(cuts, cuts[1:]) if i < j and key[i] >= 0]

    def take(self, at) -> Texts:
        out = Texts.__new__(Texts)
        out.null, out.length, out.chars, out.known, out.at, out.kept = self.null[at], self.length[at], self.chars[at], self.known, self.places()[at], {}
        return out

    def places(self) -> np.ndarray:
        """Each character's place among those known."""
        if self.at is None:
            self.at = np.searchsorted(self.known, self.chars)
        return self.at

    def bits(self, known: np.ndarray, m: int, run: tuple[int, int]) -> np.ndarray:
        """``_equal`` of a run of texts, which is made once."""
        if self.kept.get("known") is not known:
            self.kept = {"known": known}
        if run not in self.kept:
            self.kept[run] = _equal(self.chars[slice(*run), :m], known)
        return self.kept[run]


class Scratch:
    """Arrays that are used again and again: fresh memory costs more than what is done with it."""

    def __init__(self):
        self.held: dict = {}

    def get(self, name: str, shape: tuple[int, int], kind) -> np.ndarray:
        size, flat = shape[0] * shape[1], self.held.get((name, kind))
        if flat is None or len(flat) < size:
            flat = self.held[name, kind] = np.empty(size, dtype=kind)
        return flat[:size].reshape(shape)


def _equal(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which bits of each row (across) are each of the characters ``known`` (down); the last character has the top bit."""
    m = rows.shape[1]
    word = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= m)
    low = np.dtype(word).itemsize * 8 - m
    equal = np.zeros((max(len(known), 1), len(rows)), dtype=word)
    for i in range(m if len(known) else 0):
        here = np.searchsorted(known, rows[:, i]).clip(0, len(known) - 1)
        found = np.flatnonzero(known[here] == rows[:, i])
        equal[here[found], found] |= word(1 << (low + i))
    return equal


def _word_distances(equal: np.ndarray, m: int, cols: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Edit distances (cols x rows) of rows of m characters, at most 64, and columns of one length (places among the known characters)."""
    n, word = cols.shape[1], equal.dtype.type
    size, low, top = np.uint16 if max(m, n) > 255 else np.uint8, equal.dtype.itemsize * 8 - m, word(equal.dtype.itemsize * 8 - 1)
    shape = (len(cols), equal.shape[1])
    plus, minus, x, h, v, eq = (scratch.get(name, shape, word) for name in ("plus", "minus", "x", "h", "v", "eq"))
    score = scratch.get("score", shape, size)
    plus[:], minus[:], score[:] = word(((1 << m) - 1) << low), 0, m
    for j in range(n):
        np.take(equal, cols[:, j], axis=0, out=eq, mode="clip")
        np.bitwise_or(eq, minus, out=v)
        np.bitwise_and(eq, plus, out=x)
        np.add(x, plus, out=x)
        np.bitwise_xor(x, plus, out=x)
        np.bitwise_or(x, eq, out=x)
        np.bitwise_or(x, plus, out=h)
        np.invert(h, out=h)
        np.bitwise_or(h, minus, out=h)
        np.bitwise_and(x, plus, out=x)
        score += np.right_shift(h, top, out=eq).astype(size, copy=False)
        score -= np.right_shift(x, top, out=eq).astype(size, copy=False)
        np.add(h, h, out=h)
        np.bitwise_or(h, word(1), out=h)
        np.add(x, x, out=x)
        np.bitwise_or(v, h, out=plus)
        np.invert(plus, out=plus)
        np.bitwise_or(plus, x, out=plus)
        np.bitwise_and(h, v, out=minus)
    return score


def _long_distances(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """As ``_word_distances`` for rows of any length."""
    out = np.zeros((len(cols), len(rows)), dtype=np.int32)
    for c, text in enumerate(cols):
        last = [np.full(len(rows), i, dtype=np.int32) for i in range(rows.shape[1] + 1)]
        for j, x in enumerate(text):
            now = [np.full(len(rows), j + 1, dtype=np.int32)]
            for i in range(rows.shape[1]):
                now.append(np.minimum(np.minimum(now[i], last[i + 1]) + 1, last[i] + (rows[:, i] != x)))
            last = now
        out[c] = last[-1]
    return out


class Similar(NamedTuple):
    """``columns.similarity_level`` of ``columns.similarity``; fastest where texts are in order of length."""

    cuts: tuple[float, ...] = (1.0, 0.75, 0.5)

    @property
    def top(self) -> int:
        return len(self.cuts) + 1

    def prepared(self, values) -> Texts:
        return Texts(values.to_pylist())

    def levels(self, x: Texts, y: Texts, out: np.ndarray, scratch: Scratch) -> None:
        """The levels of columns y (down) and rows x (across)."""
        out[:] = 0
        for m, r in x.runs():
            for n, c in y.runs():
                longer, level = max(m, n), out[slice(*c), slice(*r)]
                level[:] = self.top
                if m != n and 1 - abs(m - n) / longer < self.cuts[-1]:
                    continue
                if m <= 64:
                    gap = _word_distances(x.bits(y.known, m, r), m, y.places()[slice(*c), :n], scratch)
                else:
                    gap = _long_distances(x.chars[slice(*r), :m], y.chars[slice(*c), :n])
                for cut in self.cuts:
                    close = [d for d in range(longer + 1) if (1 - d / longer if longer else 1.0) >= cut]
                    if close:
                        level -= np.less_equal(gap, close[-1], out=scratch.get("close", gap.shape, bool)).view(np.int8)


class Near(NamedTuple):
    """``columns.gap_level`` of the distance of two numbers."""

    cuts: tuple[float, ...]

    @property
    def top(self) -> int:
        return len(self.cuts) + 1

    def prepared(self, values) -> np.ndarray:
        """Doubles, and whether they are null."""
        null = values.is_null().to_numpy(zero_copy_only=False)
        number = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
        return np.stack([number, null.astype(float)])

    def levels(self, x: np.ndarray, y: np.ndarray, out: np.ndarray, scratch: Scratch) -> None:
        gap, close = scratch.get("gap", out.shape, float), scratch.get("close", out.shape, bool)
        with np.errstate(invalid="ignore", over="ignore"):
            np.abs(np.subtract(x[0][None, :], y[0][:, None], out=gap), out=gap)
            out[:] = self.top
            for cut in self.cuts:
                out -= np.less(gap, cut, out=close).view(np.int8)
        out[:, x[1] > 0] = 0
        out[y[1] > 0] = 0


def pick(values, at):
    """Of prepared values."""
    return values.take(at) if isinstance(values, Texts) else values[:, at]


def count(values) -> int:
    return len(values.length) if isinstance(values, Texts) else values.shape[1]


class Grid:
    """Codes of the levels of all pairs of some rows and some columns; a vector's code has a digit for each field, levels + 1 being its base."""

    def __init__(self, grids: list, x: list, y: list, scratch: Scratch):
        self.grids, self.x, self.y, self.scratch = grids, x, y, scratch

    def codes(self, c: slice) -> np.ndarray:
        """Columns ``c`` down, all rows across; good until the next call."""
        shape = (len(range(*c.indices(count(self.y[0])))), count(self.x[0]))
        code, level = self.scratch.get("code", shape, code_type(self.grids)), self.scratch.get("level", shape, np.int8)
        for k, (grid, x, y) in enumerate(zip(self.grids, self.x, self.y)):
            grid.levels(x, pick(y, c), level, self.scratch)
            code[:] = level if not k else np.add(np.multiply(code, code.dtype.type(grid.top + 1), out=code), level.view(np.uint8), out=code, casting="unsafe")
        return code


def n_codes(grids: list) -> int:
    out = 1
    for grid in grids:
        out *= grid.top + 1
    return out


def code_type(grids: list) -> type:
    return np.uint8 if n_codes(grids) <= 256 else np.int32


def vectors(grids: list) -> np.ndarray:
    """The vector of each code."""
    out, rest = np.zeros((n_codes(grids), len(grids)), dtype=np.int32), np.arange(n_codes(grids))
    for k in range(len(grids) - 1, -1, -1):
        out[:, k], rest = rest % (grids[k].top + 1), rest // (grids[k].top + 1)
    return out
