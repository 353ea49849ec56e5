import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import columns as C, levels as V
from pairloom.operators import linkage as L, patterns as P
from test_blocking import FIELDS, P_M, P_U, bag, made, plain

GRIDS = [FIELDS[0]._replace(most=C.similarity_most, grid=V.Similar()), FIELDS[1]._replace(grid=V.Near((100.0, 1000.0)))]


@pytest.mark.parametrize("longest", [7, 20, 90])
def test_text_levels(spark, longest):
    rng = random.Random(longest)
    texts = [None, "", "é"] + ["".join(rng.choice("12é") for _ in range(rng.randint(0, longest))) for _ in range(40)]
    texts += [t[:-1] + "x" for t in texts if t]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    both = table.crossJoin(table.toDF("j", "u")).select("i", "j", C.ordinal_level(F.col("t"), F.col("u")).alias("g"))
    found, grid = np.empty((len(texts), len(texts)), dtype=np.int8), V.Similar()
    grid.levels(V.Texts(texts), V.Texts(texts), found, V.Scratch())
    assert all(found[x["j"], x["i"]] == x["g"] for x in both.collect())


@pytest.mark.parametrize(("twice", "unique"), [(False, False), (True, False), (False, True)])
def test_tiled_pairs(spark, twice, unique):
    """Pairs above a weight and patterns used to need a row and a text comparison of Spark's for every pair."""
    files = made(spark, twice, unique)
    files.fields, want = GRIDS, plain(files).cache()
    pats = lambda df: [(x["pattern_id"], tuple(x["gamma"]), x["n"]) for x in df.orderBy("pattern_id").collect()]
    assert pats(files.patterns()) == pats(P.patterns(want)) and "levenshtein" not in files.patterns()._jdf.queryExecution().toString()
    for shares in ((P_M, P_U), ([[0.0, 0.5, 0.3, 0.2], [0.6, 0.0, 0.4]], [[0.3, 0.0, 0.3, 0.4], [0.1, 0.3, 0.6]])):
        for threshold in (-3.0, 1.0, 4.5):
            assert bag(files.above(*shares, threshold)) == bag(want.where(P.weight("gamma", *shares) > threshold))
    assert not unique or "levenshtein" not in files.above(P_M, P_U, 1.0)._jdf.queryExecution().toString()


@pytest.mark.parametrize("solve", [L.solve_hungarian, L.solve_auction])
def test_large_component(solve):
    """A component of many more rows than columns used to take a path or many bids for each row."""
    rng = np.random.default_rng(4)
    r, c = np.nonzero(rng.random((6000, 400)) < 0.05)
    w = rng.choice([0.4, 1.3, 1.7, 2.2], len(r), p=[0.9, 0.04, 0.03, 0.03])
    began = time.process_time()
    found = solve(6000, 400, r, c, w)
    assert time.process_time() - began < 10
    weight = dict(zip(zip(r.tolist(), c.tolist()), w.tolist()))
    assert len(found) == 400 and sum(weight[x] for x in found) == pytest.approx(400 * 2.2, abs=1e-6)
    assert len(solve(400, 6000, c, r, w)) == 400
