import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairloom.functions import levels as V
from pairloom.operators import mcmc as M

GRIDS = [V.Similar(), V.Near((100.0, 1000.0))]


def block(nrow, ncol, seed):
    """A block by values, and the same pair by pair."""
    rng = np.random.default_rng(seed)
    x, y = ([g.prepared(v) for g, v in zip(GRIDS, [pa.array([str(k) for k in rng.integers(1, 400, n)]), pa.array(rng.random(n) * 3000)])] for n in (nrow, ncol))
    cells = M.Cells(np.arange(nrow, dtype=np.int32), np.arange(ncol, dtype=np.int32), GRIDS, x, y)
    rows, cols = (z.ravel().astype(np.int32) for z in np.meshgrid(np.arange(nrow), np.arange(ncol), indexing="ij"))
    return cells, rows, cols, np.array([cells[r, c] for r, c in zip(rows, cols)])


@pytest.mark.parametrize("kernel", ["uniform", "open_column"])
def test_chains_need_no_pairs(kernel):
    """A chain used to be sent every pair; from values it makes the very same moves."""
    cells, rows, cols, code = block(30, 12, 1)
    totals, prior = np.array([5.0, 9, 20, 100, 10, 30, 60]), np.array([-1.0 * k for k in range(13)])
    a, b = (M.run_chain([part], 30, 12, V.vectors(GRIDS), [4, 3], totals, np.ones(7), np.ones(7), prior, 300, 3, kernel) for part in ((1, np.arange(30), np.arange(12), cells), (1, rows, cols, code)))
    assert sorted(a[0]) == sorted(b[0]) and a[2] == b[2] and len(a[0]) > 5


@pytest.mark.parametrize("balance", ["barker", "sqrt", "min1"])
def test_informed_moves_by_code(balance):
    """Each proposal used to weigh every pair twice; moves counted by code have to visit link sets as often as their posterior says."""
    cells = block(3, 2, 4)[0]
    ll, prior = np.random.default_rng(5).normal(0, 1.2, V.n_codes(GRIDS)), np.array([0.0, -0.5, -1.3])
    links, rng, seen = M.Links(3, 2), np.random.default_rng(9), Counter()
    for _ in range(12000):
        M.informed_step(cells, links, ll, prior, rng, balance)
        seen[tuple(links.of_row.tolist())] += 1
    want = {}
    for s in itertools.product(range(-1, 2), repeat=3):
        linked = [x for x in s if x >= 0]
        if len(set(linked)) == len(linked):
            want[s] = np.exp(prior[len(linked)] + sum(ll[cells[r, c]] for r, c in enumerate(s) if c >= 0))
    total = sum(want.values())
    assert max(abs(seen[s] / 12000 - x / total) for s, x in want.items()) < 0.02
