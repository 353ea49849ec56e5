"""Posterior samples of a one-to-one link structure within blocks: one chain a task.

Every step sweeps the blocks with the kernel chosen (an informed proposal draws a move
with weight g(posterior ratio), g being a balancing function, and accepts it by the ratio
of the weights there and back; others walk without that information), then draws the level probabilities given the links.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.functions import levels as V
from pairloom.operators import blocking as K

_LOG_BALANCE: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "barker": lambda x: x - np.logaddexp(0.0, x), "sqrt": lambda x: 0.5 * x, "min1": lambda x: np.minimum(x, 0.0), "max1": lambda x: np.maximum(x, 0.0), "identity": lambda x: x,
}


class Links:
    """A one-to-one set of links over rows and columns numbered from 0; -1 is unlinked."""

    def __init__(self, nrow: int, ncol: int):
        self.of_row, self.of_col, self.n = np.full(nrow, -1), np.full(ncol, -1), 0

    def kind(self, r: int, c: int) -> str:
        a, b = self.of_row[r], self.of_col[c]
        return "delete" if a == c else "add" if a < 0 and b < 0 else "rowswitch" if a < 0 else "colswitch" if b < 0 else "doubleswitch"

    def changes(self, r: int, c: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The links that the move at (r, c) adds, and those it removes."""
        a, b, kind = int(self.of_row[r]), int(self.of_col[c]), self.kind(r, c)
        return {"delete": ([], [(r, c)]), "add": ([(r, c)], []), "rowswitch": ([(r, c)], [(b, c)]), "colswitch": ([(r, c)], [(r, a)]), "doubleswitch": ([(r, c), (b, a)], [(r, a), (b, c)])}[kind]

    def move(self, r: int, c: int) -> tuple[int, int]:
        """Make the move at (r, c); the result is where the move back is."""
        kind, a, b = self.kind(r, c), self.of_row[r], self.of_col[c]
        if kind == "delete":
            self.of_row[r] = self.of_col[c] = -1
            self.n -= 1
            return r, c
        if kind == "add":
            self.n += 1
            back = (r, c)
        elif kind == "rowswitch":
            self.of_row[b] = -1
            back = (int(b), c)
        elif kind == "colswitch":
            self.of_col[a] = -1
            back = (r, int(a))
        else:
            self.of_row[b], self.of_col[a] = a, b
            back = (r, int(a))
        self.of_row[r], self.of_col[c] = c, r
        return back


class Places:
    """Numbers of stored pairs by (row, column), found in sorted keys: a few bytes a pair instead of a dictionary's hundreds."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray):
        self.wide = int(cols.max(initial=0)) + 1
        small = (int(rows.max(initial=0)) + 1) * self.wide < 1 << 31
        key = rows.astype(np.int32 if small else np.int64) * (np.int32 if small else np.int64)(self.wide) + cols.astype(np.int32 if small else np.int64)
        self.order = None if (key[1:] > key[:-1]).all() else np.argsort(key, kind="stable")
        self.key = key if self.order is None else key[self.order]

    def find(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs are, and whether they are stored."""
        key = np.asarray(rows, dtype=np.int64) * self.wide + cols
        at = np.searchsorted(self.key, key.astype(self.key.dtype)).clip(0, max(len(self.key) - 1, 0))
        there = (self.key[at] == key) & (np.asarray(cols) < self.wide) & (np.asarray(cols) >= 0)
        return at if self.order is None else self.order[at], there

    def _one(self, x: tuple[int, int]) -> int:
        key = int(x[0]) * self.wide + int(x[1])
        if not (len(self.key) and 0 <= x[1] < self.wide and 0 <= key <= self.key[-1]):
            return -1
        at = int(self.key.searchsorted(self.key.dtype.type(key)))
        return -1 if self.key[at] != key else at if self.order is None else int(self.order[at])

    def __contains__(self, x: tuple[int, int]) -> bool:
        return self._one(x) >= 0

    def __getitem__(self, x: tuple[int, int]) -> int:
        at = self._one(x)
        if at < 0:
            raise KeyError(x)
        return at


class Coded:
    """Values of pairs by the code of their pattern: only those asked for are written out."""

    def __init__(self, values: np.ndarray, code: np.ndarray):
        self.values, self.code = values, code

    def __getitem__(self, at):
        return self.values[self.code[at]]

    def __add__(self, x: float) -> np.ndarray:
        return self.values[self.code] + x


class Block:
    """Stored pairs of a block: rows, columns and log likelihood ratios ``ll`` by pair; ``missing`` is that of a pair that isn't stored."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, missing: float = -np.inf):
        self.rows, self.cols, self.missing = rows, cols, missing
        self.place = Places(rows, cols)
        self.row_set, self.col_set = np.unique(rows), np.unique(cols)

    def look(self, ll: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """``ll`` of any pairs within the block."""
        at, there = self.place.find(rows, cols)
        return np.where(there, ll[at], self.missing)

    def ratio(self, links: Links, ll: np.ndarray, log_prior: np.ndarray, r: int, c: int) -> float:
        """Log posterior ratio of the move at any row and column; -inf where it would add a pair that can't be linked."""
        added, removed = links.changes(r, c)
        value = lambda x: ll[self.place[x]] if x in self.place else self.missing
        gain, n = sum(value(x) for x in added), links.n + len(added) - len(removed)
        if gain == -np.inf or n >= len(log_prior):
            return -np.inf
        return gain - sum(value(x) for x in removed) + log_prior[n] - log_prior[links.n]

    def counts_delta(self, links: Links, design: np.ndarray, r: int, c: int) -> np.ndarray:
        """What the move at (r, c) adds to the level counts of the links; a pair that isn't stored counts nothing."""
        added, removed = links.changes(r, c)
        rows_of = lambda xs: design[[self.place[x] for x in xs if x in self.place]].sum(axis=0)
        return rows_of(added) - rows_of(removed)

    def ratios(self, links: Links, ll: np.ndarray, add: float, remove: float) -> np.ndarray:
        """Log posterior ratio of the move at each stored pair; -inf where a move needs a pair that can't be linked."""
        a, b = links.of_row[self.rows], links.of_col[self.cols]
        same, row, col = a == self.cols, a >= 0, b >= 0
        out = ll + add
        out[same] = remove - ll[same]
        row, col = row & ~same, col & ~same
        for mine in (row, col):
            out[mine] = ll[mine]
        out[row] -= self.look(ll, self.rows[row], a[row])
        out[col] -= self.look(ll, b[col], self.cols[col])
        both = row & col
        out[both] += self.look(ll, b[both], a[both])
        return out


class Cells:
    """A block that stores all pairs of its rows and columns, as their values alone: codes of levels are found when asked for.

    It is its own ``place``: the place of a pair is its code, so ``ll`` is by code.
    """

    missing = -np.inf
    ratio, counts_delta = Block.ratio, Block.counts_delta

    def __init__(self, row_set: np.ndarray, col_set: np.ndarray, grids: list, x: list, y: list):
        self.row_set, self.col_set, self.rows, self.place = row_set, col_set, range(len(row_set) * len(col_set)), self
        self.grids, self.order = grids, [K.in_order(x), K.in_order(y)]
        self.values = [[V.pick(v, at) for v in side] for side, at in zip((x, y), self.order)]
        self.at = [{int(i): k for k, i in enumerate(ids[at].tolist())} for ids, at in zip((row_set, col_set), self.order)]
        self.scratch, self.known, self.lines, self.sums = V.Scratch(), {}, {}, None

    def codes(self, r, c) -> np.ndarray:
        """(cols, rows) at places in order of length."""
        return V.Grid(self.grids, [V.pick(v, r) for v in self.values[0]], [V.pick(v, c) for v in self.values[1]], self.scratch).codes(slice(None)).copy()

    def __contains__(self, x: tuple[int, int]) -> bool:
        return x[0] in self.at[0] and x[1] in self.at[1]

    def __getitem__(self, x: tuple[int, int]) -> int:
        x = int(x[0]), int(x[1])
        if x not in self.known:
            if len(self.known) > 100000:
                self.known.clear()
            self.known[x] = int(self.codes(np.array([self.at[0][x[0]]]), np.array([self.at[1][x[1]]]))[0, 0])
        return self.known[x]

    def line(self, side: int, k: int) -> np.ndarray:
        """Codes of a row (side 0) with all columns, or of a column with all rows."""
        if (side, k) not in self.lines:
            while len(self.lines) > 16:
                self.lines.pop(next(iter(self.lines)))
            self.lines[side, k] = self.codes(np.array([k]), slice(None))[:, 0] if side == 0 else self.codes(slice(None), np.array([k]))[0]
        return self.lines[side, k]

    def begin(self) -> None:
        """How many pairs of each code every row has with unlinked columns, and every column with unlinked rows."""
        size = V.n_codes(self.grids)
        self.sums = [np.zeros((len(ids), size), dtype=np.int64) for ids in self.order]
        for r, c, code in K.tiles(self.grids, *self.values):
            for k in range(size):
                here = code == k
                self.sums[0][r, k] += here.sum(axis=0)
                self.sums[1][c, k] += here.sum(axis=1)
        self.linked, self.kept, self.cross = [[], []], {}, np.zeros((0, 0), dtype=int)

    def follow(self, links: Links) -> None:
        """Take up what has changed in the links."""
        if self.sums is None:
            self.begin()
        rows = np.flatnonzero(links.of_row[self.row_set] >= 0)
        ids = [self.row_set[rows].tolist(), links.of_row[self.row_set[rows]].tolist()]
        now = [[self.at[side][i] for i in ids[side]] for side in (0, 1)]
        for side in (0, 1):
            for sign, some in ((-1, set(now[side]) - set(self.linked[side])), (1, set(self.linked[side]) - set(now[side]))):
                for k in some:
                    line, other = self.line(side, k), self.sums[1 - side]
                    other[np.arange(len(line)), line] += sign
        if now != self.linked:
            self.linked = now
            self.kept = {k: self.kept[k] if k in self.kept else self.line(0, k) for k in now[0]}
            self.cross = np.array([self.kept[k][now[1]] for k in now[0]]) if now[0] else np.zeros((0, 0), dtype=int)

    def moves(self, links: Links, ll: np.ndarray, log_prior: np.ndarray, g) -> tuple[list[np.ndarray], list[np.ndarray], float]:
        """Log ratios and how many moves have them, by kind (add, delete, switch of row, of column, double), and the log of all weights' sum."""
        self.follow(links)
        n, (rows, cols) = links.n, self.linked
        add = log_prior[n + 1] - log_prior[n] if n + 1 < len(log_prior) else -np.inf
        remove = log_prior[n - 1] - log_prior[n] if n else -np.inf
        of_row, of_col = self.sums[0][rows], self.sums[1][cols]
        # pairs of unlinked rows and columns: sums of rows count unlinked columns only
        free = self.sums[0].sum(axis=0) - of_row.sum(axis=0)
        own = ll[np.diagonal(self.cross)] if len(rows) else np.zeros(0)
        cross = ll[self.cross] if len(rows) else np.zeros((0, 0))
        ratios = [ll + add, remove - own, ll[None, :] - own[:, None], ll[None, :] - own[:, None], cross - own[:, None] - own[None, :] + cross.T]
        counts = [free, np.ones(len(own), dtype=int), of_col, of_row, 1 - np.eye(len(own), dtype=int)]
        with np.errstate(divide="ignore"):
            logs = np.concatenate([(g(x) + np.log(k)).ravel() for x, k in zip(ratios, counts)])
        top = logs.max(initial=-np.inf)
        return ratios, logs, float(top + np.log(np.exp(logs - top).sum())) if np.isfinite(top) else -np.inf

    def drawn(self, kind: int, at: int, links: Links, rng: np.random.Generator) -> tuple[int, int]:
        """A move of the kind, each of those that ``at`` stands for being as likely."""
        (rows, cols), size = self.linked, self.sums[0].shape[1]
        name = lambda r, c: (int(self.row_set[self.order[0][r]]), int(self.col_set[self.order[1][c]]))
        unlinked = lambda line, taken, k: np.setdiff1d(np.flatnonzero(line == k), taken)
        if kind == 0:
            n = self.sums[0][:, at].copy()
            n[rows] = 0
            r = int(np.searchsorted(np.cumsum(n), rng.integers(n.sum()), side="right"))
            return name(r, int(rng.choice(unlinked(self.line(0, r), cols, at))))
        if kind == 1:
            return name(rows[at], cols[at])
        i, k = divmod(at, size if kind < 4 else len(rows))
        if kind == 2:
            return name(int(rng.choice(unlinked(self.line(1, cols[i]), rows, k))), cols[i])
        return name(rows[i], int(rng.choice(unlinked(self.line(0, rows[i]), cols, k)))) if kind == 3 else name(rows[i], cols[k])

    def informed(self, links: Links, ll: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator, balance: str) -> bool:
        """``informed_step`` over moves counted by kind and code; a double switch has two pairs, there and back."""
        g = _LOG_BALANCE[balance]
        ratios, logs, total = self.moves(links, ll, log_prior, g)
        if total == -np.inf:
            return False
        p = np.cumsum(np.exp(logs - total))
        at = int(np.searchsorted(p, rng.random() * p[-1], side="right").clip(0, len(p) - 1))
        kind = 0
        while at >= ratios[kind].size:
            at -= ratios[kind].size
            kind += 1
        ratio = float(ratios[kind].ravel()[at])
        back = links.move(*self.drawn(kind, at, links, rng))
        after = self.moves(links, ll, log_prior, g)[2]
        if np.log(rng.random()) < ratio + float(g(np.array(-ratio))) - after - (float(g(np.array(ratio))) - total):
            return True
        links.move(*back)
        return False


def informed_step(block: Block, links: Links, ll: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator, balance: str = "barker") -> bool:
    """One proposal in a block; ``log_prior`` by number of links. Tells whether it was accepted."""
    if isinstance(block, Cells):
        return block.informed(links, ll, log_prior, rng, balance)

    def weights() -> np.ndarray:
        n = links.n
        add = log_prior[n + 1] - log_prior[n] if n + 1 < len(log_prior) else -np.inf
        remove = log_prior[n - 1] - log_prior[n] if n else -np.inf
        return block.ratios(links, ll, add, remove)

    g = _LOG_BALANCE[balance]
    ratio = weights()
    w = g(ratio)
    top = w.max(initial=-np.inf)
    if not np.isfinite(top):
        return False
    p = np.exp(w - top)
    k = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(p) - 1))
    r, c = int(block.rows[k]), int(block.cols[k])
    added, removed = links.changes(r, c)
    twice = len(added) == 2  # such a move may be drawn at both of its pairs, and the move back too
    ways = sum(x in block.place for x in added) if twice else 1
    back = links.move(r, c)
    ways_back = [x for x in (removed if twice else [back]) if x in block.place]
    if ways_back:
        v = g(weights())
        reverse = v[block.place[ways_back[0]]] - (v.max() + np.log(np.exp(v - v.max()).sum())) + np.log(len(ways_back) / ways)
        if np.log(rng.random()) < ratio[k] + reverse - (w[k] - top - np.log(p.sum())):
            return True
    links.move(*back)
    return False


def log_move_count(nrow: int, ncol: int, nlink: int) -> float:
    """Log of how many moves a block has: its cells, the two cells of a double switch being one."""
    return float(np.log(nrow * ncol - nlink * (nlink - 1) / 2))


def uniform_step(block: Block, links: Links, ll: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator) -> bool:
    """One of all moves in the block, each as likely; accepted by the posterior ratio and the count of moves there and back."""
    nrow, ncol = len(block.row_set), len(block.col_set)
    inside = lambda: int((links.of_row[block.row_set] >= 0).sum())
    while True:
        r, c = int(rng.choice(block.row_set)), int(rng.choice(block.col_set))
        if links.kind(r, c) != "doubleswitch" or rng.random() < 0.5:
            break
    ratio, before = block.ratio(links, ll, log_prior, r, c), log_move_count(nrow, ncol, inside())
    if ratio == -np.inf:
        return False
    back = links.move(r, c)
    if np.log(rng.random()) < ratio + before - log_move_count(nrow, ncol, inside()):
        return True
    links.move(*back)
    return False


def open_column_step(block: Block, links: Links, ll: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator, p_remove: float = 0.5) -> bool:
    """A row of the block: if unlinked, an open column is proposed; if linked, its removal or another open column."""
    r = int(rng.choice(block.row_set))
    free = block.col_set[links.of_col[block.col_set] < 0]
    linked = links.of_row[r] >= 0
    if linked and rng.random() < p_remove:
        c, correction = int(links.of_row[r]), -np.log(p_remove) - np.log(len(free) + 1)
    elif len(free):
        c, correction = int(rng.choice(free)), 0.0 if linked else np.log(p_remove) + np.log(len(free))
    else:
        return False
    if np.log(rng.random()) < block.ratio(links, ll, log_prior, r, c) + correction:
        links.move(r, c)
        return True
    return False


def gibbs_step(block: Block, links: Links, ll: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator) -> bool:
    """Exact draw for a block of one row or one column: no link, or one of its pairs. Tells whether the link changed."""
    now = next((k for k, (r, c) in enumerate(zip(block.rows, block.cols)) if links.of_row[r] == c), -1)
    n = links.n - (now >= 0)
    add = log_prior[n + 1] - log_prior[n] if n + 1 < len(log_prior) else -np.inf
    w = np.concatenate([[0.0], ll + add])
    w = np.exp(w - w.max())
    new = int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), side="right").clip(0, len(w) - 1)) - 1
    if new == now:
        return False
    for k in (now, new):
        if k >= 0:
            links.move(int(block.rows[k]), int(block.cols[k]))
    return True


def block_step(block: Block, links: Links, ll: np.ndarray, log_prior: np.ndarray, rng: np.random.Generator, kernel: str) -> bool:
    """One update by the kernel named: a balancing function, "uniform" or "open_column"; with "+gibbs", stars are drawn exactly, single pairs always."""
    name, _, star = kernel.partition("+")
    if len(block.rows) == 1 or star and min(len(block.row_set), len(block.col_set)) == 1:
        return gibbs_step(block, links, ll, log_prior, rng)
    if name == "uniform":
        return uniform_step(block, links, ll, log_prior, rng)
    if name == "open_column":
        return open_column_step(block, links, ll, log_prior, rng)
    return informed_step(block, links, ll, log_prior, rng, name)


def run_chain(parts: list[tuple], nrow: int, ncol: int, vectors: np.ndarray, nlevels, totals, prior_m, prior_u, log_prior, steps: int, seed: int, balance: str = "barker", start: list[tuple[int, int]] = (), missing: float = -np.inf) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Link intervals (row, col, start, stop), (step, nlinks, p_m, p_u) and (label, steps at which its links changed) of one chain.

    ``parts``: (label, rows, cols, code) of each block, ``code`` being a pair's place among ``vectors`` of levels.
    The probabilities are drawn for the links at the start, and again after each step's sweep.
    """
    rng = np.random.default_rng(seed)
    design = np.concatenate([(vectors[:, [k]] == np.arange(1, n + 1)).astype(float) for k, n in enumerate(nlevels)], axis=1)
    links, blocks = Links(nrow, ncol), [code if isinstance(code, Cells) else Block(rows, cols, missing) for _, rows, cols, code in parts]
    of_row = np.full(nrow, -1)
    for k, block in enumerate(blocks):
        of_row[block.row_set] = k
    for r, c in start:
        if missing == -np.inf and (r, c) not in blocks[of_row[r]].place:
            raise ValueError(OUTSIDE)
        if links.kind(r, c) != "add":
            raise ValueError("start links have to be one-to-one")
        links.move(r, c)
    moves = np.zeros(len(parts), dtype=int)
    bounds = np.concatenate([[0], np.cumsum(nlevels)])

    def standing() -> set[tuple[int, int]]:
        return {(int(r), int(links.of_row[r])) for r in np.flatnonzero(links.of_row >= 0)}

    def draw(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return np.concatenate([rng.dirichlet(np.maximum(counts[i:j], 0) + prior[i:j]) for i, j in zip(bounds, bounds[1:])])

    def parameters(now: set) -> tuple[np.ndarray, np.ndarray]:
        linked = np.zeros(design.shape[1])
        for x in now:
            k = of_row[x[0]]
            if x in blocks[k].place:
                linked += design[blocks[k].place[x] if isinstance(blocks[k], Cells) else parts[k][3][blocks[k].place[x]]]
        return draw(linked, prior_m), draw(totals - linked, prior_u)

    now = standing()
    open_, trace, params = dict.fromkeys(now, 1), [], []
    p_m, p_u = parameters(now)
    for step in range(1, steps + 1):
        ll = design @ (np.log(np.maximum(p_m, 1e-300)) - np.log(np.maximum(p_u, 1e-300)))
        for k, block in enumerate(blocks):
            moves[k] += block_step(block, links, ll if isinstance(block, Cells) else Coded(ll, parts[k][3]), log_prior, rng, balance)
        now = standing()
        trace += [(*x, since, step - 1) for x in [x for x in open_ if x not in now] if (since := open_.pop(x)) < step]
        for x in now - open_.keys():
            open_[x] = step
        p_m, p_u = parameters(now)
        params.append((step, links.n, p_m, p_u))
    trace += [(*x, since, steps) for x, since in open_.items() if since <= steps]
    return trace, params, [(part[0], n) for part, n in zip(parts, moves.tolist())]


OUTSIDE = "start links have to lie within blocks, on stored pairs unless the others have a likelihood"


class _Gathered:
    """A chain's pairs as they come, by label, row and column: 10 bytes or so a pair, codes instead of ids and vectors."""

    def __init__(self, nlevels: list[int]):
        self.nlevels, self.begun, self.pieces, self.runs, self.cols, self.codes = nlevels, [], [], [], {}, {}

    def add(self, batch: pa.RecordBatch) -> None:
        one = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        begun = one["start"].to_numpy(zero_copy_only=False)
        n = int(begun.sum())  # sorted first
        row, col = one["row_id"].to_numpy(), one["col_id"].to_numpy()
        self.begun += zip(row[:n].tolist(), col[:n].tolist())
        if n == len(row):
            return
        row, col, label = row[n:], col[n:], one["label"].slice(n).to_numpy()
        levels = one["gamma"].slice(n).flatten().to_numpy().reshape(len(row), len(self.nlevels))
        code = np.zeros(len(row), dtype=np.int64)
        for k, top in enumerate(self.nlevels):  # a level that isn't among the field's counts nothing, as a missing one
            code = code * (top + 1) + np.where((levels[:, k] > 0) & (levels[:, k] <= top), levels[:, k], 0)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])])
        if self.runs and self.runs[-1] == (label[0], row[0]):
            new[0] = False
        at = (len(self.runs) - 1 + np.cumsum(new)).astype(np.int32)
        self.runs += zip(label[new].tolist(), row[new].tolist())
        self.pieces.append((at, self._numbered(self.cols, col).astype(np.int32), self._numbered(self.codes, code).astype(np.int16 if math.prod(x + 1 for x in self.nlevels) < 1 << 15 else np.int32)))

    @staticmethod
    def _numbered(known: dict, values: np.ndarray) -> np.ndarray:
        some, at = np.unique(values, return_inverse=True)
        return np.array([known.setdefault(x, len(known)) for x in some.tolist()])[at]

    def blocks(self) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """(label, rows, cols, code) of each block, row ids and column ids by number, and vectors by code."""
        row_ids, of_run = np.unique(np.array([r for _, r in self.runs], dtype=np.int64), return_inverse=True)
        ids = np.array(list(self.cols), dtype=np.int64)
        col_ids, of_col = np.unique(ids, return_inverse=True)
        vectors = np.zeros((len(self.codes), len(self.nlevels)), dtype=int)
        rest = np.array(list(self.codes), dtype=np.int64)
        for k in range(len(self.nlevels) - 1, -1, -1):
            vectors[:, k], rest = rest % (self.nlevels[k] + 1), rest // (self.nlevels[k] + 1)
        columns = []
        for k in range(3):
            columns.append(np.concatenate([x[k] for x in self.pieces]) if self.pieces else np.zeros(0, dtype=np.int32))
            self.pieces = [tuple(None if i == k else y for i, y in enumerate(x)) for x in self.pieces]
        at, col, code = columns
        label = np.array([x for x, _ in self.runs], dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.zeros(0, dtype=int)
        cuts = np.searchsorted(at, np.append(first, len(label)).astype(np.int32))
        parts = [(int(label[f]), of_run.astype(np.int32)[at[i:j]], of_col.astype(np.int32)[col[i:j]], code[i:j]) for f, i, j in zip(first, cuts, cuts[1:])]
        return parts, row_ids, col_ids, vectors


#: Blocks of one row or column, or of no more pairs than this, are stored pair by pair.
SMALL = 256


class _Valued:
    """A chain's rows and columns as they come, by label, side (rows first) and id, instead of its pairs."""

    def __init__(self, grids: list):
        self.grids, self.got, self.begun = grids, [], []

    def add(self, batch: pa.RecordBatch) -> None:
        self.got.append(batch)

    def blocks(self) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """As ``_Gathered.blocks``; the codes of a large block are its ``Cells``."""
        every = pa.Table.from_batches(self.got).combine_chunks().to_batches()[0]
        label, side, ids = (every.column(k).to_numpy() for k in (1, 2, 3))
        row_ids, col_ids = np.unique(ids[side == 0]), np.unique(ids[side == 1])
        parts, new = [], np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
        for i, j in zip(new[:-1].tolist(), new[1:].tolist()):
            mid = i + int(np.searchsorted(side[i:j], 1))
            if mid in (i, j):
                continue
            r, c = np.searchsorted(row_ids, ids[i:mid]).astype(np.int32), np.searchsorted(col_ids, ids[mid:j]).astype(np.int32)
            x, y = ([g.prepared(every.column(4 + k).slice(a, b - a)) for k, g in enumerate(self.grids)] for a, b in ((i, mid), (mid, j)))
            cells = Cells(r, c, self.grids, x, y)
            if min(len(r), len(c)) > 1 and len(r) * len(c) > SMALL:
                parts.append((int(label[i]), r, c, cells))
            else:
                at = [np.argsort(o) for o in cells.order]
                parts.append((int(label[i]), np.repeat(r, len(c)), np.tile(c, len(r)), cells.codes(slice(None), slice(None))[at[1]][:, at[0]].T.ravel()))
        self.got = []
        return parts, row_ids, col_ids, V.vectors(self.grids)


def _by_values(files: K.Blocked) -> DataFrame | None:
    """(label, side, id, values) of files whose last key is a label, if a label's rows and columns all share a block and ids are there once."""
    if files._grids() is None or files.keys[-1] != "label":
        return None
    cast = lambda df, side, key, names: df.select(F.col("label").cast("long").alias("label"), F.lit(side).alias("side"), F.col(key).cast("long").alias("id"), *[F.col(v).alias(x) for v, x in zip(names, files.x)], F.xxhash64(*files.keys).alias("key"))
    both = cast(files.rows, 0, "row_id", files.x).unionByName(cast(files.cols, 1, "col_id", files.y))
    one = both.groupBy("label").agg((F.min("key") == F.max("key")).alias("one")).where("not one").isEmpty()
    return both.drop("key") if one and both.groupBy("side", "id").count().where("count > 1").isEmpty() else None


def _chains(pairs: DataFrame | K.Blocked, nlevels, totals, prior_m, prior_u, log_prior, steps, chains, seed, kernel, start, missing, result: Callable, schema: str) -> DataFrame:
    """One task a chain, each given all in-block pairs, sorted and in batches; ``result`` turns ids and what a chain made into rows."""
    totals, prior_m, prior_u = (np.asarray(x, dtype=float) for x in (totals, prior_m, prior_u))
    valued, grids = None, None
    if isinstance(pairs, K.Blocked):
        grids = pairs._grids()
        if start is None and missing == -np.inf and grids is not None and [g.top for g in grids] == list(nlevels):
            valued = _by_values(pairs)
        pairs = pairs.pairs() if valued is None else valued
    kept = valued if valued is not None else pairs.select("row_id", "col_id", "gamma", "label", F.lit(False).alias("start"))
    if start is not None:
        kept = kept.unionByName(start.select("row_id", "col_id", F.lit(None).cast(kept.schema["gamma"].dataType).alias("gamma"), F.lit(None).cast(kept.schema["label"].dataType).alias("label"), F.lit(True).alias("start")))
    fields, by_value = pairs.sparkSession.createDataFrame([], schema).schema, valued is not None
    by = ["label", "side", "id"] if by_value else [F.desc("start"), "label", "row_id", "col_id"]

    def one(chain: int, got: _Gathered) -> pa.RecordBatch:
        parts, row_ids, col_ids, vectors = got.blocks()
        if not by_value:
            got.pieces, got.runs = [], []
        where = lambda side: {int(x): part[0] for part in parts for x in np.unique(part[side])}
        of_row, of_col = (where(1), where(2)) if got.begun else ({}, {})
        number = lambda ids, x: int(np.searchsorted(ids, x)) if x in ids else -1
        first = sorted((number(row_ids, r), number(col_ids, c)) for r, c in got.begun)
        if any(r < 0 or c < 0 or of_row[r] != of_col[c] for r, c in first):
            raise ValueError(OUTSIDE)
        most = min(len(row_ids), len(col_ids))
        prior = np.asarray([log_prior(n) for n in range(most + 1)] if callable(log_prior) else log_prior, dtype=float)
        made = run_chain(parts, len(row_ids), len(col_ids), vectors, nlevels, totals, prior_m, prior_u, prior, steps, seed + 7919 * chain, kernel, first, missing)
        rows = [(chain, *x) for x in result(row_ids, col_ids, *made)]
        return pa.RecordBatch.from_pylist([dict(zip(fields.names, (x.item() if isinstance(x, np.generic) else x for x in r))) for r in rows], schema=to_arrow_schema(fields))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for chain in np.unique(ids).tolist():
                if chain != now:
                    if got is not None:
                        yield one(now, got)
                    now, got = chain, _Gathered(nlevels) if not by_value else _Valued(grids)
                i, j = np.searchsorted(ids, [chain, chain + 1])
                got.add(batch.slice(i, j - i))
        if got is not None:
            yield one(now, got)

    each = kept.select(F.explode(F.sequence(F.lit(1), F.lit(chains))).alias("chain_id"), "*")
    dealt = each.repartitionById(chains, F.col("chain_id") - 1).sortWithinPartitions("chain_id", *by)
    return dealt.mapInArrow(every, schema)


def sample(pairs: DataFrame, nlevels: list[int], totals, prior_m, prior_u, log_prior, steps: int, chains: int = 1, seed: int = 1, kernel: str = "barker", start: DataFrame | None = None, missing: float = float("-inf")) -> DataFrame:
    """(chain_id, row_id, col_id, start, stop) from in-block pairs (row_id, col_id, gamma, label).

    ``log_prior`` is a list by number of links or a function of it; ``kernel`` is as in ``block_step``.
    Chains start from the links (row_id, col_id) of ``start``, none if it isn't given; ``missing`` is the log likelihood
    ratio of a pair within a block that isn't stored, which may be linked only if that is above -inf.
    The links at the end are those whose stop is ``steps``.  An empty table of pairs gives no rows.
    A chain needs all in-block pairs at once; chains are spread over tasks.
    """
    def intervals(row_ids, col_ids, trace, params, moves):
        return [(row_ids[i], col_ids[j], a, b) for i, j, a, b in sorted(trace)]

    return _chains(pairs, nlevels, totals, prior_m, prior_u, log_prior, steps, chains, seed, kernel, start, missing, intervals, "chain_id int, row_id long, col_id long, start int, stop int")


def sample_counts(pairs: DataFrame, nlevels: list[int], totals, prior_m, prior_u, log_prior, steps: int, chains: int = 1, seed: int = 1, kernel: str = "barker", start: DataFrame | None = None, missing: float = float("-inf")) -> DataFrame:
    """(chain_id, row_id, col_id, n): the chains of ``sample``, of which only the steps a link stood leave the task."""
    def counted(row_ids, col_ids, trace, params, moves):
        n = Counter()
        for i, j, a, b in trace:
            n[i, j] += b - a + 1
        return [(row_ids[i], col_ids[j], k) for (i, j), k in sorted(n.items())]

    return _chains(pairs, nlevels, totals, prior_m, prior_u, log_prior, steps, chains, seed, kernel, start, missing, counted, "chain_id int, row_id long, col_id long, n long")


def sample_parameters(pairs: DataFrame, nlevels: list[int], totals, prior_m, prior_u, log_prior, steps: int, chains: int = 1, seed: int = 1, kernel: str = "barker", start: DataFrame | None = None, missing: float = float("-inf")) -> DataFrame:
    """(chain_id, step, nlinks, p_m, p_u): number of links and drawn probabilities of the chains of ``sample``."""
    def drawn(row_ids, col_ids, trace, params, moves):
        return [(step, n, m.tolist(), u.tolist()) for step, n, m, u in params]

    return _chains(pairs, nlevels, totals, prior_m, prior_u, log_prior, steps, chains, seed, kernel, start, missing, drawn, "chain_id int, step int, nlinks long, p_m array<double>, p_u array<double>")


def sample_transitions(pairs: DataFrame, nlevels: list[int], totals, prior_m, prior_u, log_prior, steps: int, chains: int = 1, seed: int = 1, kernel: str = "barker", start: DataFrame | None = None, missing: float = float("-inf")) -> DataFrame:
    """(chain_id, label, n): at how many steps of the chains of ``sample`` the links of each block changed."""
    def moved(row_ids, col_ids, trace, params, moves):
        return moves

    return _chains(pairs, nlevels, totals, prior_m, prior_u, log_prior, steps, chains, seed, kernel, start, missing, moved, "chain_id int, label long, n long")
