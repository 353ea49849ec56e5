import tracemalloc

import numpy as np

from pairloom.operators import mcmc


def test_block_holds_few_bytes_a_pair():
    rows, cols = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(1000), np.arange(200), indexing="ij"))
    tracemalloc.start()
    block = mcmc.Block(rows, cols)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 * len(rows)
    assert block.place[999, 3] == 999 * 200 + 3 and (999, 200) not in block.place and (1000, 0) not in block.place


def test_places_of_unsorted_pairs():
    rng = np.random.default_rng(3)
    cells = rng.permutation(60)[:40]
    rows, cols = cells // 6, cells % 6
    place = mcmc.Places(rows, cols)
    for r in range(-1, 12):
        for c in range(-1, 8):
            want = [k for k in range(40) if (rows[k], cols[k]) == (r, c)]
            assert ((r, c) in place) == bool(want)
            if want:
                assert place[r, c] == want[0]
