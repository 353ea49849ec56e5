import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import columns as C
from pairloom.operators import blocks as B, linkage as L, patterns as P, search as S
from pairloom.operators.blocking import Blocked, Folded
from test_blocking import FIELDS, P_M, P_U, bag, made, plain

CHEAP = [FIELDS[0]._replace(most=C.similarity_most), FIELDS[1]]


def copied(files, n=4):
    """Every row and column n times, under ids of its own."""
    more = lambda df, key: df.join(df.sparkSession.range(n)).withColumn(key, F.col(key) + 1000 * F.col("id")).drop("id")
    return Blocked(more(files.rows, "row_id"), more(files.cols, "col_id"), files.fields, tuple(files.keys))


@pytest.mark.parametrize(("twice", "unique"), [(False, False), (True, False), (False, True)])
def test_components_of_folded_files(spark, twice, unique):
    files = made(spark, twice, unique) if unique else copied(made(spark, twice, unique))
    for threshold in (1.0, 4.5):
        folded = Folded(files)
        assert (folded.members is None) == (twice or unique)
        want = plain(files).where(P.weight("gamma", P_M, P_U) > threshold).select("row_id", "col_id").cache()
        edges = folded.counted(folded.files.above(P_M, P_U, threshold))
        assert bag(folded.expanded(edges).select("row_id", "col_id")) == bag(want)
        labelled = L.bipartite_components(want)
        assert bag(folded.expanded(L.bipartite_components(edges)).select("row_id", "col_id", "label")) == bag(labelled)
        assert bag(folded.nodes(L.bipartite_nodes(edges))) == bag(B.labelled_nodes(labelled))
        if not twice:
            assert bag(L.component_sizes(L.bipartite_components(edges))) == bag(L.component_sizes(labelled))


def test_edges_are_made_once(spark):
    """Components used to go through their edges twice: once for the labels, once to hand them on."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i // 3) for i in range(60)], "row_id long, col_id long").mapInArrow(look, "row_id long, col_id long")
    assert L.bipartite_components(edges).count() == 60 and seen.value == 60


@pytest.mark.parametrize("shares", [(P_M, P_U), ([[0.0, 0.5, 0.3, 0.2], [0.6, 0.0, 0.4]], [[0.3, 0.0, 0.3, 0.4], [0.1, 0.3, 0.6]])])
def test_costly_measure_comes_last(spark, shares):
    """Weights above a threshold used to need the text measure of every pair."""
    files, cheap = made(spark, unique=True), made(spark, unique=True)
    cheap.fields = CHEAP
    for threshold in (-3.0, 0.0, 1.0, 4.5):
        assert bag(cheap.above(*shares, threshold)) == bag(files.pairs().where(P.weight("gamma", *shares) > threshold))
    plan = cheap.above(P_M, P_U, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 1
    assert plan.index("levenshtein(") < plan.index("Filter", plan.index("levenshtein(")) < plan.index("Join")  # the plan reads upwards


def test_cheap_bound(spark):
    rng = random.Random(3)
    texts = ["", None] + ["".join(rng.choice("12") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    both = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    x = both.select(C.similarity(F.col("a"), F.col("b")).alias("s"), C.similarity_most(F.col("a"), F.col("b")).alias("m"))
    assert x.where("(s IS NULL) <> (m IS NULL) OR s > m OR (s = 1) <> (m = 1)").count() == 0


@pytest.mark.parametrize("solve", [L.flow_hungarian, L.flow_auction])
def test_flows_weigh_as_much_as_single_links(solve):
    rng = random.Random(8)
    for _ in range(60):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        rows, cols = ([rng.randint(1, 5) for _ in range(k)] for k in (n, m))
        edges = {(i, j): rng.choice([0.4, 1.0, 1.7, 3.1]) for i in range(n) for j in range(m) if rng.random() < 0.6}
        r, c, w = (np.array(x) for x in ([i for i, _ in edges], [j for _, j in edges], list(edges.values())))
        single = [(a, b, x) for (i, j), x in edges.items() for a in range(sum(rows[:i]), sum(rows[: i + 1])) for b in range(sum(cols[:j]), sum(cols[: j + 1]))]
        if not single:
            continue
        a, b, x = map(np.array, zip(*single))
        weight = {(p, q): z for p, q, z in single}
        best = sum(weight[link] for link in L.solve_hungarian(sum(rows), sum(cols), a, b, x))
        found = solve(n, m, r, c, w, rows, cols)
        assert sum(edges[i, j] * k for i, j, k in found) == pytest.approx(best, abs=1e-6)
        assert all(k > 0 for *_, k in found) and len({f[:2] for f in found}) == len(found)
        assert all(sum(k for i, _, k in found if i == a) <= rows[a] for a in range(n)) and all(sum(k for _, j, k in found if j == b) <= cols[b] for b in range(m))


@pytest.mark.parametrize("solver", ["hungarian", "auction"])
def test_folded_assignment(spark, solver):
    files = copied(made(spark))
    folded = Folded(files)
    want = P.pair_weights(plain(files), P_M, P_U, 1.0).cache()
    got = folded.links(L.flows(folded.counted(P.pair_weights(folded.files.above(P_M, P_U, 1.0), P_M, P_U, 1.0)), solver)).collect()
    assert folded.members is not None and len({x["row_id"] for x in got}) == len({x["col_id"] for x in got}) == len(got) > 20
    weight = {(x["row_id"], x["col_id"]): x["w"] for x in want.collect()}
    assert all(weight[x["row_id"], x["col_id"]] == x["w"] for x in got)
    assert sum(x["w"] for x in got) == pytest.approx(sum(x["w"] for x in L.assign(want).collect()), abs=1e-6)


def test_many_equal_rows_are_solved_as_one():
    """Work used to grow with the square of equal rows; here they are 40,000 by 40,000."""
    r, c = np.divmod(np.arange(9), 3)
    w = np.array([3.0, 1.0, 2.0, 1.0, 3.0, 2.5, 0.5, 2.0, 1.0])
    rows, cols = [40000, 100, 7000], [30000, 9000, 5000]
    for solve in (L.flow_hungarian, L.flow_auction):
        found = solve(3, 3, r, c, w, rows, cols)
        assert sum(w[3 * i + j] * k for i, j, k in found) == pytest.approx(3 * 30000 + 2 * 5000 + 3 * 100 + 2 * 7000 + 1 * 1900, abs=1e-4)


def test_folded_blocks(spark):
    files = copied(made(spark))
    folded, weights = Folded(files), P.pair_weights(plain(files), P_M, P_U).cache()
    for most in (5, 40, 600):
        want = L.blocks(weights, most, 0.5, 1.0)
        got = folded.expanded(L.blocks(folded.counted(P.pair_weights(folded.files.above(P_M, P_U, 0.5), P_M, P_U)), most, 0.5, 1.0))
        assert got.columns == want.columns and bag(got) == bag(want)


@pytest.mark.parametrize("solver", ["hungarian", "recycled"])
def test_folded_path(spark, solver):
    """Matchings of one weight may have other patterns, since weights add up by field; so weights are compared, not paths."""
    files, nlevels, prior = copied(made(spark)), [4, 3], np.full(7, 1.01)
    p_m, p_u = np.concatenate(P_M), np.concatenate(P_U)
    folded, single = S.Patterned(files, nlevels), S.Patterned(plain(files), nlevels)
    assert folded.n.tolist() == single.n.tolist()
    for penalty in (0.0, 2.5):
        a, b = (x.matched(p_m, p_u, penalty, solver)[1] @ (x.weights(p_m, p_u) - penalty) for x in (folded, single))
        assert a == pytest.approx(b, abs=1e-5) and a > 0
    got = S.search(files, nlevels, p_m, p_u, prior, prior, mininc=0.1, solver=solver)
    trace, all_pairs = got["trace"].collect(), {x[:2] for x in bag(plain(files).select("row_id", "col_id"))}
    assert len(got["steps"]) > 2
    for x in got["steps"]:
        now = [t for t in trace if t["start"] <= x["step"] <= t["stop"]]
        assert len({t["row_id"] for t in now}) == len({t["col_id"] for t in now}) == len(now) == x["n_links"]
        assert all((t["row_id"], t["col_id"]) in all_pairs for t in now)


def test_path_stores_only_patterns_that_may_be_linked(spark):
    """All pairs used to be stored, twice."""
    files = made(spark, unique=True)
    data = S.Patterned(files, [4, 3])
    p_m, p_u = np.concatenate(P_M), np.concatenate(P_U)
    for penalty in (3.0, 1.0):
        data.matched(p_m, p_u, penalty, "hungarian")
        stored = data.pairs(np.array([], dtype=int))
        assert stored.count() == plain(files).where(P.weight("gamma", P_M, P_U) > penalty).count() < data.n.sum() / 2
