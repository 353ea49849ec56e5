"""Queries with SQL against DuckDB; the others against brute force and properties."""

import itertools
import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pairloom import registry
from pairloom.operators import blocks, linkage, links, mcmc, patterns, search
from pairloom.sources import store

SF = "/root/testdata/sf0.001"


def rows(found):
    clean = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return Counter(tuple(clean(v).replace("-0.0000", "0.0000") for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.select(*names).collect()) == rows(want.fetchall())


def matching_total(weight):
    """Largest total of a partial matching: by component, over the sets of columns taken by its rows so far."""
    total, label, rows_of, cols_of = 0.0, components(weight), {}, {}
    for r, c in weight:
        rows_of.setdefault(label["r", r], set()).add(r)
        cols_of.setdefault(label["r", r], set()).add(c)
    for k, members in rows_of.items():
        best = {frozenset(): 0.0}
        for r in members:
            step = dict(best)
            for taken, t in best.items():
                for c in cols_of[k] - taken:
                    w = weight.get((r, c), 0.0)
                    if w > 0:
                        step[taken | {c}] = max(step.get(taken | {c}, 0.0), t + w)
            best = step
        total += max(best.values())
    return total


@pytest.mark.parametrize("name", ["assign_hungarian", "assign_auction"])
def test_assignments(spark, name):
    got = registry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    weight = {(r["row_id"], r["col_id"]): r["w"] for r in registry._weights(spark, "/root/testdata/sf0.01", 1.0).collect()}
    assert len({r["row_id"] for r in got}) == len({r["col_id"] for r in got}) == len(got) > 10
    assert all(weight[r["row_id"], r["col_id"]] == r["w"] for r in got)
    assert sum(r["w"] for r in got) == pytest.approx(matching_total(weight), abs=1e-6)


def test_blocks(spark):
    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in registry.queries()["blocks"](spark, sf).collect()]
    weight = {(r["row_id"], r["col_id"]): r["w"] for r in registry._weights(spark, sf).collect()}
    by = {}
    for r, c, w, label, threshold in got:
        assert weight[r, c] == w > threshold
        by.setdefault((label, threshold), set()).add((r, c))
    for members in by.values():
        assert len({r for r, _ in members}) * len({c for _, c in members}) <= 30
        label = components(members)
        assert len(set(label.values())) == 1
    assert len({r[:2] for r in got}) == len(got)
    # blocks of one row or column with another threshold don't share records
    rows_of = [(k, {r for r, _ in m}) for k, m in by.items()]
    assert all(not (a & b) for (ka, a), (kb, b) in itertools.combinations(rows_of, 2) if ka[1] == kb[1])
    with pytest.raises(ValueError):
        linkage.blocks(registry._weights(spark, SF), 30, 0.5, 0.0)
    endless = spark.createDataFrame([(i, j, math.inf) for i in range(3) for j in range(3)], "row_id long, col_id long, w double")
    with pytest.raises(ValueError):
        linkage.blocks(endless, 4, 0.0, 1.0)


def components(edges):
    root = {}
    for r, c in edges:
        for x in (("r", r), ("c", c)):
            root.setdefault(x, x)
    for r, c in list(edges) * len(edges):
        low = min(root["r", r], root["c", c])
        root["r", r] = root["c", c] = low
    return root


def test_em_settles_where_a_step_changes_nothing(spark):
    pats = patterns.patterns(registry.pairs(spark, "/root/testdata/sf0.01"))
    fit = patterns.estimate_em(pats, np.concatenate(registry.P_M), np.concatenate(registry.P_U), 0.01, registry.NLEVELS, tol=1e-10)
    table, p = patterns.m_step(patterns.e_step(pats, patterns.split_fields(fit["p_m"], registry.NLEVELS), patterns.split_fields(fit["p_u"], registry.NLEVELS), fit["p"]), registry.NLEVELS)
    got = sorted(table.collect())
    assert fit["converged"] and p == pytest.approx(fit["p"], abs=1e-8)
    assert [r["p_m"] for r in got] == pytest.approx(list(fit["p_m"]), abs=1e-7) and [r["p_u"] for r in got] == pytest.approx(list(fit["p_u"]), abs=1e-7)


@pytest.mark.parametrize("name", ["mcmc_trace", "mcmc_trace_uniform", "mcmc_trace_open_column"])
def test_traces_are_one_to_one(spark, name):
    got = registry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    inside = {(r["row_id"], r["col_id"]) for r in registry.queries()["inside_blocks"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) > 10 and {(r["row_id"], r["col_id"]) for r in got} <= inside
    for step in (1, 57, 200):
        for chain in (1, 2):
            now = [r for r in got if r["chain_id"] == chain and r["start"] <= step <= r["stop"]]
            assert len({r["row_id"] for r in now}) == len({r["col_id"] for r in now}) == len(now)


def test_chain_counts_and_parameters(spark):
    sf = "/root/testdata/sf0.01"
    counts = registry.queries()["mcmc_counts"](spark, sf).collect()
    assert counts and all(1 <= r["n"] <= 200 for r in counts)
    for r in registry.queries()["mcmc_parameters"](spark, sf).collect():
        assert len(r["p_m"]) == len(r["p_u"]) == 7 and sum(r["p_m"][:4]) == pytest.approx(1) and sum(r["p_u"][4:]) == pytest.approx(1)


def plain_search(spark, sf, mininc, prior=1.01):
    """The path over the whole matrix of pairs, in plain loops, by the Hungarian kernel."""
    found = registry.pairs(spark, sf).collect()
    rows_, cols = sorted({r["row_id"] for r in found}), sorted({r["col_id"] for r in found})
    gamma = {(rows_.index(r["row_id"]), cols.index(r["col_id"])): tuple(r["gamma"]) for r in found}
    n = Counter(gamma.values())
    at = {(0, v): v - 1 for v in range(1, 5)} | {(1, v): 3 + v for v in range(1, 4)}
    levels = lambda g: [at[k, v] for k, v in enumerate(g) if v]

    def modes(linked):
        m, u = np.full(7, prior - 1), np.full(7, prior - 1)
        for g, k in n.items():
            for i in levels(g):
                m[i] += linked[g]
                u[i] += k - linked[g]
        return [np.concatenate([x[:4] / x[:4].sum(), x[4:] / x[4:].sum()]) for x in (m, u)]

    m, u, penalty, out = np.concatenate(registry.P_M), np.concatenate(registry.P_U), 0.0, []
    while True:
        while True:
            w = {g: sum(math.log(m[i] / u[i]) for i in levels(g)) for g in n}
            mat = np.zeros((len(rows_), len(cols)))
            for (i, j), g in gamma.items():
                mat[i, j] = max(0.0, w[g] - penalty)
            linked = Counter(gamma[x] for x in linkage.hungarian(mat))
            new = modes(linked)
            settled = np.allclose(new[0], m, atol=1e-12) and np.allclose(new[1], u, atol=1e-12)
            m, u = new
            if settled:
                break
        w = {g: sum(math.log(m[i] / u[i]) for i in levels(g)) for g in n}
        after, above = search.next_penalty(list(w.values()), penalty, mininc, matched=[w[g] for g in linked if linked[g]])
        out.append((round(penalty, 5), sum(linked.values()), above))
        if not above:
            return out
        m, u = modes(Counter({g: k for g, k in linked.items() if w[g] > after}))
        penalty = after


def test_path_as_the_plain_version(spark):
    got = sorted(registry.queries()["penalized_path"](spark, SF).collect())
    assert [(round(r["penalty"], 5), r["n_links"], r["n_above"]) for r in got] == plain_search(spark, SF, 0.1)
    assert all(r["converged"] for r in got) and got[-1]["n_above"] == 0
    trace = registry.queries()["penalized_trace"](spark, SF).collect()  # by auction: as many links at each step
    for r in got:
        assert sum(t["start"] <= r["step"] <= t["stop"] for t in trace) == r["n_links"]


def test_fits_settle_by_counts_too(spark):
    prior = np.full(7, 1.01)
    a, b = (search.fit(registry.pairs(spark, SF), registry.NLEVELS, np.concatenate(registry.P_M), np.concatenate(registry.P_U), prior, prior, 1.0, settle=s) for s in ("parameters", "counts"))
    assert a["converged"] and b["converged"] and a["counts"].tolist() == b["counts"].tolist() and np.allclose(a["p_m"], b["p_m"])


def test_fits_by_recycled_prices(spark):
    prior = np.full(7, 1.01)
    a, b = (search.fit(registry.pairs(spark, SF), registry.NLEVELS, np.concatenate(registry.P_M), np.concatenate(registry.P_U), prior, prior, 1.0, solver=s) for s in ("auction", "recycled"))
    assert a["converged"] and b["converged"] and a["counts"].sum() == b["counts"].sum() and np.allclose(a["p_m"], b["p_m"])


def test_link_constructors_refuse_what_is_not_one_to_one(spark):
    make = lambda *r: spark.createDataFrame(list(r), "row_id long, col_id long")
    for bad in (make((1, 1), (1, 2)), make((1, 1), (2, 1)), make((None, 1)), make((0, 1)), make((1, 9))):
        with pytest.raises(ValueError):
            links.checked_links(bad, 5, 5)
    with pytest.raises(ValueError):
        links.links_from_maps(make((1, 1), (2, 0)), make((2, 1)))
    assert links.checked_links(make(), 5, 5).count() == 0
    with pytest.raises(ValueError):
        patterns.check_candidates(spark.createDataFrame([(1, 1, [1]), (1, 1, [2])], "row_id long, col_id long, gamma array<int>"))
    with pytest.raises(ValueError):
        blocks.component_ranges(spark.createDataFrame([("row", 1, 1), ("row", 2, 2), ("row", 3, 1)], "side string, id long, label long"))


def brute(w):
    n, m = w.shape
    return max(sum(max(w[i, c], 0.0) for i, c in enumerate(p) if c < m) for p in itertools.permutations(range(n + m), n))


def test_solvers():
    rng = np.random.default_rng(2)
    for _ in range(40):
        w = np.round(rng.normal(0.5, 1, (rng.integers(1, 4), rng.integers(1, 4))), 2)
        for solve in (linkage.hungarian, linkage.auction):
            found = solve(w)
            assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
            assert sum(w[i, j] for i, j in found) == pytest.approx(brute(w), abs=1e-6)


def test_moves_have_inverses():
    rng = np.random.default_rng(3)
    links = mcmc.Links(4, 5)
    for _ in range(300):
        before = links.of_row.copy()
        back = links.move(int(rng.integers(4)), int(rng.integers(5)))
        after = links.of_row.copy()
        again = links.move(*back)
        assert (links.of_row == before).all() and links.n == (before >= 0).sum()
        links.move(*again)
        assert (links.of_row == after).all()


@pytest.mark.parametrize("kernel", ["barker", "sqrt", "min1", "max1", "uniform", "open_column"])
def test_steps_reach_the_posterior(kernel):
    ll = np.array([[1.0, -0.5], [0.3, 0.8]])
    rows_, cols = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    links, rng, seen = mcmc.Links(2, 2), np.random.default_rng(4), Counter()
    block, prior = mcmc.Block(rows_, cols), np.array([0.0, -0.4, -0.8])
    for _ in range(30_000):
        mcmc.block_step(block, links, ll.ravel(), prior, rng, kernel)
        seen[tuple(links.of_row.tolist())] += 1
    weight = {s: math.exp(sum(ll[r, c] for r, c in enumerate(s) if c >= 0) - 0.4 * sum(c >= 0 for c in s)) for s in itertools.product((-1, 0, 1), repeat=2) if s[0] != s[1] or s[0] < 0}
    for s, w in weight.items():
        assert seen[s] / 30_000 == pytest.approx(w / sum(weight.values()), abs=0.02)


@pytest.mark.parametrize("shape", [(1, 1), (1, 3), (3, 1)])
def test_gibbs_steps_reach_the_posterior(shape):
    r, c = np.indices(shape).reshape(2, -1)
    ll, links, rng, seen = np.array([0.6, -0.3, 1.1])[: r.size], mcmc.Links(*shape), np.random.default_rng(5), Counter()
    block, prior = mcmc.Block(r, c), np.array([0.0, -0.4])
    for _ in range(20_000):
        mcmc.block_step(block, links, ll, prior, rng, "barker+gibbs")
        seen[next((k for k in range(r.size) if links.of_row[r[k]] == c[k]), -1)] += 1
        assert links.n == (links.of_row >= 0).sum() <= 1
    weight = {-1: 1.0} | {k: math.exp(x - 0.4) for k, x in enumerate(ll)}
    for k, w in weight.items():
        assert seen[k] / 20_000 == pytest.approx(w / sum(weight.values()), abs=0.02)


def test_counts_follow_the_moves():
    rng, links = np.random.default_rng(6), mcmc.Links(3, 4)
    r, c = np.indices((3, 4)).reshape(2, -1)
    block, design = mcmc.Block(r, c), rng.integers(0, 2, (12, 5)).astype(float)
    total = lambda: sum((design[block.place[i, int(j)]] for i, j in enumerate(links.of_row) if j >= 0), np.zeros(5))
    for _ in range(200):
        i, j = int(rng.integers(3)), int(rng.integers(4))
        want = total() + block.counts_delta(links, design, i, j)
        links.move(i, j)
        assert (total() == want).all()


def test_next_penalty():
    n = search.next_penalty
    assert n([0.5, 1.0, 2.0, 4.0], 0.0, 1.0) == (1.5, 2)
    assert n([0.5, 1.0], 0.0, 1.0) == (1.0, 0) and n([], 2.0, 0.5) == (2.5, 0)
    assert n([3.0], 0.0, 1.0) == (3.0, 0) and n([3.0, 4.0], 0.0, 1.0) == (3.5, 1)
    # past the least weight of a linked pattern
    assert n([1.0, 2.0, 3.0, 5.0], 0.0, 0.1, matched=[3.0, 5.0]) == (4.0, 1)
    assert n([1.0, 2.0], 0.0, 0.1, matched=[]) == (0.1, 0) and n([1.0, 2.0], 0.0, 2.0, matched=[2.0]) == (2.0, 0)
    assert n([1.0, 2.0], 0.0, 0.5, matched=[-1.0, 2.0]) == (0.5, 2)


def test_links_are_added_only_where_free(spark):
    now = spark.createDataFrame([(1, 1), (2, 3)], "row_id long, col_id long")
    wanted = spark.createDataFrame([(1, 2), (3, 3), (4, 4)], "row_id long, col_id long")
    assert sorted(map(tuple, linkage.add_links(now, wanted).collect())) == [(1, 1), (2, 3), (4, 4)]


def test_store(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id\tname\n001\tNA\n002\t\n")
    assert [tuple(r) for r in store.read_delimited(spark, str(tmp_path / "a.txt")).collect()] == [("001", "NA"), ("002", "")]
    blocks = spark.createDataFrame([(1, 2, 1)], "row_id long, col_id long, label long")
    store.write_blocks(blocks, str(tmp_path / "b"))
    assert [tuple(r) for r in store.read_blocks(spark, str(tmp_path / "b")).collect()] == [(1, 2, 1)]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        store.write_blocks(blocks, str(tmp_path / "b"))


@pytest.mark.parametrize("kernel", ["barker", "uniform"])
def test_pairs_that_are_not_stored_reach_the_posterior(kernel):
    stored = {(0, 0): 1.0, (0, 1): -0.5, (1, 0): 0.3, (1, 2): 0.4, (2, 1): 0.2, (2, 2): -0.1}
    r, c = (np.array(x) for x in zip(*stored))
    links, rng, seen = mcmc.Links(3, 3), np.random.default_rng(7), Counter()
    block, prior, missing = mcmc.Block(r, c, missing=-0.7), np.array([0.0, -0.4, -0.8, -1.2]), -0.7
    # informed proposals reach a pair that isn't stored only by a double switch, and leave it by stored pairs
    for _ in range(40_000):
        mcmc.block_step(block, links, np.array(list(stored.values())), prior, rng, kernel)
        seen[tuple(links.of_row.tolist())] += 1
    value = lambda s: sum(stored.get((i, j), missing) - 0.4 for i, j in enumerate(s) if j >= 0)
    states = [s for s in itertools.product((-1, 0, 1, 2), repeat=3) if len({j for j in s if j >= 0}) == sum(j >= 0 for j in s)]
    weight = {s: math.exp(value(s)) for s in states if kernel == "uniform" or s in seen}
    for s, x in weight.items():
        assert seen[s] / 40_000 == pytest.approx(x / sum(weight.values()), abs=0.02)


def test_ratios_by_table_are_those_by_move():
    rng, links = np.random.default_rng(8), mcmc.Links(4, 5)
    cells = np.array([x for x in itertools.product(range(4), range(5)) if rng.random() < 0.7])
    ll, prior = rng.normal(size=len(cells)), -0.3 * np.arange(6)
    for missing in (-np.inf, -0.5):
        block, links = mcmc.Block(cells[:, 0], cells[:, 1], missing), mcmc.Links(4, 5)
        for _ in range(200):
            each = block.ratios(links, ll, prior[links.n + 1] - prior[links.n], prior[links.n - 1] - prior[links.n] if links.n else -np.inf)
            for k, (r, c) in enumerate(cells):
                assert each[k] == pytest.approx(block.ratio(links, ll, prior, int(r), int(c)))
            k = int(rng.integers(len(cells)))
            if each[k] > -np.inf:
                links.move(int(cells[k, 0]), int(cells[k, 1]))


def test_chains_start_from_links(spark):
    pairs = spark.createDataFrame([(1, 10, [2], 1), (1, 11, [1], 1), (2, 11, [2], 1), (5, 20, [1], 5)], "row_id long, col_id long, gamma array<int>, label long")
    start = spark.createDataFrame([(1, 10), (2, 11), (5, 20)], "row_id long, col_id long")
    often = lambda n: 50.0 * n  # noqa: E731  # so likely that links stay
    args = (pairs, [2], [40, 40], [1, 1], [1, 1], often)
    trace = mcmc.sample(*args, steps=9, chains=2, start=start).collect()
    assert sorted(trace) == [(k, i, j, 1, 9) for k in (1, 2) for i, j in ((1, 10), (2, 11), (5, 20))]
    assert {tuple(x) for x in mcmc.sample_transitions(*args, steps=9, start=start).collect()} == {(1, 1, 0), (1, 5, 0)}
    never = lambda n: -500.0 * n
    assert mcmc.sample(pairs, [2], [40, 40], [1, 1], [1, 1], never, steps=60, start=start, kernel="uniform").where("stop = 60").count() == 0
    moved = {x["label"]: x["n"] for x in mcmc.sample_transitions(pairs, [2], [40, 40], [1, 1], [1, 1], never, steps=60, start=start).collect()}
    assert moved[5] == 1 and moved[1] >= 2
    outside = spark.createDataFrame([(2, 10)], "row_id long, col_id long")
    with pytest.raises(Exception, match="start links"):
        mcmc.sample(*args, steps=2, start=outside).collect()
    assert mcmc.sample(*args, steps=3, start=outside, missing=0.0).count() > 0
    assert mcmc.sample(pairs.limit(0), [2], [0, 0], [1, 1], [1, 1], often, steps=3).count() == 0


def test_assign_edges(spark):
    weights = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, 2.5), (2, 1, 2.0), (2, 2, float("inf")), (3, 2, float("inf")), (None, 3, 1.0), (4, None, 1.0), (5, 5, None), (6, 6, -1.0)], "row_id long, col_id long, w double")
    for solver in ("hungarian", "auction"):
        found = {(x["row_id"], x["col_id"], x["w"]) for x in linkage.assign(weights, solver).collect()}
        assert (1, 1, 3.0) in found and len(found) == 2 and sum(x[2] == float("inf") for x in found) == 1
        assert linkage.assign(weights.limit(0), solver).count() == 0


def test_recycled_prices_keep_the_total(spark):
    rng, prices = np.random.default_rng(9), None
    cells = [(int(i), int(j), float(x)) for i in range(12) for j in range(9) for x in [rng.choice([1.0, 2.0, 2.5, 4.0])] if rng.random() < 0.4]
    for shift in (0.0, 0.6, 1.5):
        weights = spark.createDataFrame([(i, j, w - shift) for i, j, w in cells], "row_id long, col_id long, w double")
        links, prices = linkage.assign_recycled(weights, prices)
        best = sum(x["w"] for x in linkage.assign(weights).collect())
        got = links.collect()
        assert sum(x["w"] for x in got) == pytest.approx(best, abs=1e-6)
        assert len({x["row_id"] for x in got}) == len({x["col_id"] for x in got}) == len(got)
    assert {x["side"] for x in prices.collect()} == {"row", "col"}
