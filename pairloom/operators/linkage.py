"""Clusters of the pair graph, one-to-one assignment, changes between link sets, and traces."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.operators.graph import connected_components
from pairloom.plans.staging import stage


def bipartite_nodes(edges: DataFrame) -> DataFrame:
    """(side, id, label) of every node with an edge, once; label: the component's smallest row_id. Edges are gone through once."""
    both = edges.select((2 * F.col("row_id")).alias("src"), (2 * F.col("col_id") + 1).alias("dst"))
    roots = connected_components(both)
    least = roots.where("node % 2 = 0").groupBy("root").agg(F.min(F.expr("node div 2")).alias("label"))
    return roots.join(least, "root").select(F.when(F.col("node") % 2 == 0, "row").otherwise("col").alias("side"), F.expr("(node - pmod(node, 2)) div 2").alias("id"), "label")


def bipartite_components(edges: DataFrame) -> DataFrame:
    """(row_id, col_id, label) of edges, and their other columns; label: the component's smallest row_id. Edges are staged, so they are made once."""
    edges = stage(edges, "edges")
    return edges.join(bipartite_nodes(edges).where("side = 'row'").select(F.col("id").alias("row_id"), "label"), "row_id")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(label, n_rows, n_cols, n_edges); rows and columns that stand for ``n_row`` and ``n_col`` others count as many, if there are such columns."""
    if "n_row" not in labelled.columns:
        return labelled.groupBy("label").agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("col_id").alias("n_cols"), F.count(F.lit(1)).alias("n_edges"))
    side = lambda key, n, name: labelled.groupBy("label", key).agg(F.max(n).alias(n)).groupBy("label").agg(F.sum(n).alias(name))
    edges = labelled.groupBy("label").agg(F.sum(F.col("n_row") * F.col("n_col")).alias("n_edges"))
    return side("row_id", "n_row", "n_rows").join(side("col_id", "n_col", "n_cols"), "label").join(edges, "label").select("label", "n_rows", "n_cols", "n_edges")


def summarise(sizes: DataFrame) -> DataFrame:
    """One row: pairs, largest component in pairs, largest side, components, singletons."""
    area = F.col("n_rows") * F.col("n_cols")
    return sizes.agg(
        F.coalesce(F.sum(area), F.lit(0)).alias("n_pairs"), F.coalesce(F.max(area), F.lit(0)).alias("max_pairs"), F.coalesce(F.max(F.greatest("n_rows", "n_cols")), F.lit(0)).alias("max_side"),
        F.count(F.lit(1)).alias("n_components"), F.count_if((F.col("n_rows") == 1) & (F.col("n_cols") == 1)).alias("n_singletons"),
    )


def blocks(weights: DataFrame, max_pairs: int, threshold: float, step: float) -> DataFrame:
    """(row_id, col_id, w, label, threshold): components above a threshold, which rises for those of too many pairs until none is left.

    Labels are (smallest row_id at the component's own threshold); only oversized components go into another round.
    Pairs at or below the first threshold aren't needed.  Columns n_row and n_col count as in ``component_sizes``, and stay.
    """
    if step <= 0:
        raise ValueError("step has to be above 0")
    names = ["row_id", "col_id", "w", *[c for c in ("n_row", "n_col") if c in weights.columns]]
    todo, done, top = weights.where(F.col("w") > threshold), None, None
    while True:
        labelled = stage(bipartite_components(todo), "blocks")
        if done is None:  # beyond the largest finite weight no threshold parts a component
            top = labelled.where(F.col("w") < float("inf")).agg(F.max("w")).first()[0]
        large = component_sizes(labelled).where(F.col("n_rows") * F.col("n_cols") > max_pairs).select("label")
        ready = labelled.join(large, "label", "left_anti").select(*names, "label", F.lit(threshold).alias("threshold"))
        done = ready if done is None else done.unionByName(ready)
        if top is None or threshold > top:
            if not large.isEmpty():
                raise ValueError("a component of infinite weights has too many pairs")
            return done
        threshold += step
        todo = stage(labelled.join(large, "label", "left_semi").select(*names).where(F.col("w") > threshold), "oversized")
        if todo.isEmpty():
            return done


def _finite(w: np.ndarray) -> np.ndarray:
    """Weights with infinite ones set above the sum of all others, so that as many of them as can be are taken."""
    known = np.isfinite(w)
    return np.where(known, w, 1.0 + np.abs(w[known]).sum())


def solve_hungarian(n: int, m: int, r: np.ndarray, c: np.ndarray, w: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a partial matching of largest total weight over edges (r, c, w) of positive weight, each given once.

    Shortest augmenting paths over the edges alone, so memory grows with edges and not with rows times columns.
    """
    return [(i, j) for i, j, _ in flow_hungarian(n, m, r, c, w, [1] * n, [1] * m)]


def flow_hungarian(n: int, m: int, r: np.ndarray, c: np.ndarray, w: np.ndarray, rows: list[int], cols: list[int]) -> list[tuple[int, int, int]]:
    """``solve_hungarian`` where row i stands for ``rows``[i] equal ones, and columns likewise: (row, column, links between theirs).

    Paths start on the side of fewer nodes, so there are as many searches; a search goes no further than the nearest free place.
    """
    if n > m:
        return [(i, j, k) for j, i, k in flow_hungarian(m, n, c, r, w, cols, rows)]
    order = np.argsort(r, kind="stable")
    ends, starts = np.asarray(c)[order].astype(np.int64), np.searchsorted(np.asarray(r)[order], np.arange(n + 1))
    cost = -_finite(np.asarray(w, dtype=float))[order]
    near = [ends[i:j] for i, j in zip(starts, starts[1:])]
    costs = [cost[i:j] for i, j in zip(starts, starts[1:])]
    u, v = [min(float(x.min(initial=0.0)), 0.0) for x in costs], np.zeros(m)  # a row may also stay open, which costs nothing
    flow: list[dict[int, int]] = [{} for _ in range(m)]
    room, least = np.array(cols, dtype=np.int64), np.full(m, np.inf)
    for s in range(n):
        left = rows[s]
        while left:
            back, closed, heap, touched = {}, set(), [], []
            reached, via, todo, base = {s: 0.0}, {}, [s], 0.0
            bound, goal, last = np.inf, -1, -1  # the nearest free column (m: a row's open place) and the row before it
            while True:
                for i in todo:
                    if base - u[i] < bound:
                        bound, goal, last = base - u[i], m, i
                    j, d = near[i], costs[i] + (base - u[i]) - v[near[i]]
                    better = np.flatnonzero((d < bound) & (d < least[j]))
                    if not len(better):
                        continue
                    j, d = j[better], d[better]
                    free = room[j] > 0
                    if free.any():
                        at = int(np.flatnonzero(free)[d[free].argmin()])
                        bound, goal, last = float(d[at]), int(j[at]), i
                    for x, y in zip(d[~free].tolist(), j[~free].tolist()):
                        if x < bound and y not in closed:
                            least[y], back[y] = x, i
                            touched.append(y)
                            heapq.heappush(heap, (x, y))
                while heap and (heap[0][1] in closed or heap[0][0] > least[heap[0][1]]):
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= bound:
                    break
                base, end = heapq.heappop(heap)
                closed.add(end)
                todo = [i for i in flow[end] if i not in reached]
                for i in todo:
                    reached[i], via[i] = base, end
            for i, d in reached.items():
                u[i] += bound - d
            for j in closed:
                v[j] += least[j] - bound
            least[touched] = np.inf
            path, units = [(last, goal)], left if goal == m else min(left, int(room[goal]))
            while path[-1][0] != s:
                i = path[-1][0]
                units = min(units, flow[via[i]][i])
                path.append((back[via[i]], via[i]))
            left -= units
            if goal < m:
                room[goal] -= units
            for i, j in path:
                if j < m:
                    flow[j][i] = flow[j].get(i, 0) + units
                if i != s:
                    flow[via[i]][i] -= units
                    if not flow[via[i]][i]:
                        del flow[via[i]][i]
    return [(i, j, k) for j in range(m) for i, k in flow[j].items()]


def solve_auction(n: int, m: int, r: np.ndarray, c: np.ndarray, w: np.ndarray, tol: float = 1e-7, scale: float = 0.2, price: list[float] | None = None) -> list[tuple[int, int]]:
    """As ``solve_hungarian``, by an auction with falling increments; the total is within ``tol`` of the best (1e-10 a row or column if that is more)."""
    return [(i, j) for i, j, _ in flow_auction(n, m, r, c, w, [1] * n, [1] * m, tol, scale, price)]


def flow_auction(n: int, m: int, r: np.ndarray, c: np.ndarray, w: np.ndarray, rows: list[int], cols: list[int], tol: float = 1e-7, scale: float = 0.2, price: list[float] | None = None) -> list[tuple[int, int, int]]:
    """As ``flow_hungarian``, by the auction of ``solve_auction``.

    Each row may also take a place of its own, each column's bidder that column or the place of a row with an edge
    to it, all for 0.  So all bidders can be placed at once, and any prices (of columns, then of rows' places) are right to
    start with: a phase goes on from those before, and ``price``, if given, is read and left as it ends.
    Equal columns are lots of one price each; the cheapest one is a column's price, and a bid goes up to the next best
    of the other columns, for as many of a lot as the bidder still lacks.  Where no node stands for several and no prices
    are given, the side of fewer nodes bids alone (``_one_sided``).
    """
    w = _finite(w)
    if price is None and set(rows) | set(cols) <= {1}:
        last = max(tol / max(n + m, 1), 1e-10)
        if n > m:
            return [(i, j, 1) for j, i in _one_sided(m, n, np.asarray(c), np.asarray(r), w, last, scale)]
        return [(i, j, 1) for i, j in _one_sided(n, m, np.asarray(r), np.asarray(c), w, last, scale)]
    near: list[list[tuple[int, float]]] = [[(m + i, 0.0)] for i in range(n)] + [[(j, 0.0)] for j in range(m)]
    for i, j, x in zip(r.tolist(), c.tolist(), w.tolist()):
        near[i].append((j, x))
        near[n + j].append((m + i, 0.0))
    price = [0.0] * (m + n) if price is None else price
    last = max(tol / max(sum(rows) + sum(cols), 1), 1e-10)
    eps = max(float(w.max(initial=0.0)) * scale, last)
    while True:
        lots = [[(x, -1, k)] for x, k in zip(price, [*cols, *rows])]  # of each column: (price, who holds them, how many), a heap
        left, todo = [*rows, *cols], list(range(m + n))
        while todo:
            i = todo.pop()
            while left[i]:
                best = second = -np.inf
                at = -1
                for j, x in near[i]:
                    net = x - price[j]
                    if net > best:
                        best, second, at = net, best, j
                    elif net > second:
                        second = net
                low, owner, units = lots[at][0]
                taken = min(left[i], units)
                bid = (low + (best - second if second > -np.inf else 0.0) + eps, i, taken)
                if taken == units:
                    heapq.heapreplace(lots[at], bid)
                else:
                    lots[at][0] = (low, owner, units - taken)
                    heapq.heappush(lots[at], bid)
                price[at] = lots[at][0][0]
                left[i] -= taken
                if owner >= 0:
                    if not left[owner] and owner != i:
                        todo.append(owner)
                    left[owner] += taken
        if eps <= last:
            found: dict[tuple[int, int], int] = {}
            for j in range(m):
                for _, i, units in lots[j]:
                    if i < n:
                        found[i, j] = found.get((i, j), 0) + units
            return [(i, j, k) for (i, j), k in found.items()]
        eps = max(eps * scale, last)


def _one_sided(n: int, m: int, r: np.ndarray, c: np.ndarray, w: np.ndarray, last: float, scale: float) -> list[tuple[int, int]]:
    """Pairs of a matching within n * ``last`` of the best: rows bid for columns with falling increments; a row may stay open for 0.

    A column that nobody holds has to end at price 0.  Where one is left with a price from before, it bids for a row
    in turn (the reverse auction of Bertsekas and Castanon, 1992), which only raises rows' profits, so each phase ends.
    """
    def sides(key: np.ndarray, other: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(size + 1))
        return [other[order[i:j]] for i, j in zip(cuts, cuts[1:])], [w[order[i:j]] for i, j in zip(cuts, cuts[1:])]

    (near, worth), (far, back) = sides(r, c, n), sides(c, r, m)
    price, eps = np.zeros(m), max(float(w.max(initial=0.0)) * scale, last)
    while True:
        holder, mine, profit, todo = [-1] * m, [-1] * n, np.zeros(n), list(range(n))
        while todo:
            i = todo.pop()
            net = worth[i] - price[near[i]]
            k = int(net.argmax()) if len(net) else -1
            if k < 0 or net[k] <= 0:
                mine[i], profit[i] = -1, 0.0
                continue
            best, net[k] = float(net[k]), -np.inf
            second, j = max(float(net.max()), 0.0), int(near[i][k])
            price[j] += best - second + eps
            profit[i] = second - eps
            if holder[j] >= 0:
                todo.append(holder[j])
            holder[j], mine[i] = i, j
        todo = [j for j in np.flatnonzero(price > 0).tolist() if holder[j] < 0]
        while todo:
            j = todo.pop()
            offer = back[j] - profit[far[j]]
            k = int(offer.argmax())
            best, offer[k] = float(offer[k]), -np.inf
            if best <= eps:
                price[j] = 0.0
                continue
            rise, i = min(best, best - float(offer.max()) + eps), int(far[j][k])
            price[j] = best - rise
            profit[i] += rise
            old, mine[i], holder[j] = mine[i], j, i
            if old >= 0:
                holder[old] = -1
                if price[old] > 0:
                    todo.append(old)
        if eps <= last:
            return [(i, j) for i, j in enumerate(mine) if j >= 0]
        eps = max(eps * scale, last)


def _dense(solve, w: np.ndarray) -> list[tuple[int, int]]:
    r, c = np.nonzero(w > 0)
    return solve(*w.shape, r, c, w[r, c])


def hungarian(w: np.ndarray) -> list[tuple[int, int]]:
    """Matching of largest total weight in a whole matrix; pairs of weight 0 or less stay open."""
    return _dense(solve_hungarian, w)


def auction(w: np.ndarray) -> list[tuple[int, int]]:
    """As ``hungarian``, by an auction."""
    return _dense(solve_auction, w)


def _weigher(m: int, r: np.ndarray, c: np.ndarray, w: np.ndarray):
    """The weight of an edge by its row and column, without an object for each edge."""
    key = r.astype(np.int64) * m + c
    order = np.argsort(key)
    key = key[order]
    return lambda i, j: float(w[order[np.searchsorted(key, i * m + j)]])


def _components(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of single pairs and stars, picked in SQL; and the edges (label, row_id, col_id, w, n_row, n_col) of all other components."""
    counted = weights if "n_row" in weights.columns else weights.withColumns({"n_row": F.lit(1).cast("long"), "n_col": F.lit(1).cast("long")})
    known = counted.where("w > 0 AND row_id IS NOT NULL AND col_id IS NOT NULL").groupBy("row_id", "col_id").agg(*[F.max(x).alias(x) for x in ("w", "n_row", "n_col")])
    labelled = stage(bipartite_components(known), "assign")
    sizes = component_sizes(labelled).select("label", (F.least("n_rows", "n_cols") == 1).alias("star"))
    marked = labelled.join(sizes, "label")
    best = Window.partitionBy("label").orderBy(F.desc("w"), "row_id", "col_id")
    stars = marked.where("star").withColumn("k", F.row_number().over(best)).where("k = 1").select("row_id", "col_id", "w", F.lit(1).cast("long").alias("n"))
    return stars, marked.where("not star").select("label", "row_id", "col_id", "w", "n_row", "n_col")


def assign(weights: DataFrame, solver: str = "hungarian") -> DataFrame:
    """(row_id, col_id, w) of a one-to-one matching of largest total weight; only positive weights count.

    Exact by component.  Single pairs and stars are picked by their largest weight, in SQL;
    a solver sees only components with several rows and columns, one at a time, as edges.
    Of repeated pairs the largest weight counts; pairs with a null are left out.
    """
    return flows(weights.select("row_id", "col_id", "w"), solver).drop("n")


def flows(weights: DataFrame, solver: str = "hungarian") -> DataFrame:
    """``assign`` over (row_id, col_id, w, n_row, n_col), a row standing for n_row equal ones and a column for n_col: (row_id, col_id, w, n), n links between theirs."""
    stars, general = _components(weights)
    solve = {"hungarian": flow_hungarian, "auction": flow_auction}[solver]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at_r, r = np.unique(pdf["row_id"], return_index=True, return_inverse=True)
        cols, at_c, c = np.unique(pdf["col_id"], return_index=True, return_inverse=True)
        w = pdf["w"].to_numpy()
        weigh = _weigher(len(cols), r, c, w)
        found = solve(len(rows), len(cols), r, c, w, pdf["n_row"].to_numpy()[at_r].tolist(), pdf["n_col"].to_numpy()[at_c].tolist())
        return pd.DataFrame({"row_id": [rows[i] for i, _, _ in found], "col_id": [cols[j] for _, j, _ in found], "w": [weigh(i, j) for i, j, _ in found], "n": [k for _, _, k in found]}, columns=["row_id", "col_id", "w", "n"])

    return stars.unionByName(general.groupBy("label").applyInPandas(one, "row_id long, col_id long, w double, n long"))


def assign_recycled(weights: DataFrame, prices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``assign`` by auction, from the prices of an earlier call: the links, and prices (side, id, price) for the next.

    ``side`` is "col" or "row" (the place of a row that stays open).  Prices change how long the auction takes, not the total;
    0 where none is known.  Components settled without an auction have no prices; both results are staged.
    """
    links, prices = flows_recycled(weights.select("row_id", "col_id", "w"), prices)
    return links.drop("n"), prices


def flows_recycled(weights: DataFrame, prices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``assign_recycled`` for rows and columns that stand for several, as ``flows``."""
    stars, general = _components(weights)
    if prices is not None:
        of = lambda side: prices.where(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.col("price").alias(f"{side}_price"))
        general = general.join(of("row"), "row_id", "left").join(of("col"), "col_id", "left")
    else:
        general = general.withColumns({"row_price": F.lit(0.0), "col_price": F.lit(0.0)})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at_r, r = np.unique(pdf["row_id"], return_index=True, return_inverse=True)
        cols, at_c, c = np.unique(pdf["col_id"], return_index=True, return_inverse=True)
        w = pdf["w"].to_numpy()
        weigh = _weigher(len(cols), r, c, w)
        price = pdf["col_price"].fillna(0.0).to_numpy()[at_c].tolist() + pdf["row_price"].fillna(0.0).to_numpy()[at_r].tolist()
        found = flow_auction(len(rows), len(cols), r, c, w, pdf["n_row"].to_numpy()[at_r].tolist(), pdf["n_col"].to_numpy()[at_c].tolist(), price=price)
        out = [("link", rows[i], cols[j], weigh(i, j), k) for i, j, k in found]
        out += [("col", None, j, x, None) for j, x in zip(cols, price)] + [("row", i, None, x, None) for i, x in zip(rows, price[len(cols) :])]
        return pd.DataFrame(out, columns=["side", "row_id", "col_id", "w", "n"]).astype({"row_id": "Int64", "col_id": "Int64", "n": "Int64"})

    solved = stage(general.groupBy("label").applyInPandas(one, "side string, row_id long, col_id long, w double, n long"), "auction")
    links = stars.unionByName(solved.where("side = 'link'").drop("side"))
    return stage(links, "links"), solved.where("side <> 'link'").select("side", F.coalesce("row_id", "col_id").alias("id"), F.col("w").alias("price"))


def links_added(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select("row_id", "col_id").join(old, ["row_id", "col_id"], "left_anti")


def links_removed(new: DataFrame, old: DataFrame) -> DataFrame:
    return links_added(old, new)


def link_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """(row_id, col_id, change): 'added' or 'removed', in one pass."""
    both = new.select("row_id", "col_id", F.lit(1).alias("s")).unionByName(old.select("row_id", "col_id", F.lit(-1).alias("s"))).groupBy("row_id", "col_id").agg(F.sum("s").alias("s"))
    return both.where("s <> 0").select("row_id", "col_id", F.when(F.col("s") > 0, "added").otherwise("removed").alias("change"))


def links_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, one column: whether the two sets have the same links."""
    return link_difference(a, b).agg((F.count(F.lit(1)) == 0).alias("equal"))


def invert_links(links: DataFrame) -> DataFrame:
    """Links with the two files exchanged."""
    return links.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"))


def add_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links and those wanted (themselves one-to-one) whose row and column are both free; the others are left out."""
    free = wanted.select("row_id", "col_id").join(links.select("row_id"), "row_id", "left_anti").join(links.select("col_id"), "col_id", "left_anti")
    return links.select("row_id", "col_id").unionByName(free)


def link_switches(new: DataFrame, old: DataFrame) -> DataFrame:
    """(row_id, old_col, new_col) of rows linked in both sets, to different columns."""
    both = new.select("row_id", F.col("col_id").alias("new_col")).join(old.select("row_id", F.col("col_id").alias("old_col")), "row_id")
    return both.where("new_col <> old_col").select("row_id", "old_col", "new_col")


def precision_recall(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: links estimated, true and in both, precision and recall (null where nothing is estimated or true)."""
    marks = estimate.select("row_id", "col_id", F.lit(1).alias("e"), F.lit(0).alias("t")).unionByName(truth.select("row_id", "col_id", F.lit(0).alias("e"), F.lit(1).alias("t")))
    each = marks.groupBy("row_id", "col_id").agg(F.max("e").alias("e"), F.max("t").alias("t"))
    one = each.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n_links"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_true"), F.coalesce(F.sum(F.col("e") * F.col("t")), F.lit(0)).alias("n_both"))
    share = lambda n: F.when(F.col(n) > 0, F.col("n_both") / F.col(n))
    return one.withColumns({"precision": share("n_links"), "recall": share("n_true")})


def link_counts(trace: DataFrame, burnin: int = 0, *by: str) -> DataFrame:
    """(row_id, col_id, *by, n): steps after ``burnin`` at which a link stood, from intervals (row_id, col_id, start, stop)."""
    return trace.where(F.col("stop") > burnin).groupBy("row_id", "col_id", *by).agg(F.sum(F.col("stop") - F.greatest(F.col("start"), F.lit(burnin + 1)) + 1).alias("n"))


def step_links(trace: DataFrame, step: int) -> DataFrame:
    return trace.where((F.col("start") <= step) & (F.col("stop") >= step)).select("row_id", "col_id")


def segment_links(trace: DataFrame, first: int, last: int) -> DataFrame:
    if last < first:
        raise ValueError("the segment ends before it starts")
    return trace.where((F.col("start") <= first) & (F.col("stop") >= last)).select("row_id", "col_id")


def group_counts(trace: DataFrame, groups: DataFrame, key: str | list[str] = "row_id") -> DataFrame:
    """(step, gid, n): links standing at each step by group of their row, column or pair (both keys); gid 0 is left out."""
    steps = trace.withColumn("step", F.explode(F.sequence("start", "stop")))
    return steps.join(groups.where("gid > 0"), key).groupBy("step", "gid").agg(F.count(F.lit(1)).alias("n"))


def intervals(steps: DataFrame) -> DataFrame:
    """(row_id, col_id, start, stop) from one row for each link and step."""
    run = F.col("step") - F.row_number().over(Window.partitionBy("row_id", "col_id").orderBy("step"))
    return steps.withColumn("run", run).groupBy("row_id", "col_id", "run").agg(F.min("step").alias("start"), F.max("step").alias("stop")).drop("run")


def bayes_estimate(counts: DataFrame, nsteps: int) -> DataFrame:
    """Links that stood in more than half of the steps."""
    return counts.where(F.col("n") > nsteps / 2).select("row_id", "col_id")


def _level_vector(counts: DataFrame, nlevels: list[int]) -> np.ndarray:
    start = np.concatenate([[0], np.cumsum(nlevels)[:-1]])
    out = np.zeros(sum(nlevels))
    for r in counts.collect():
        out[start[r["field"] - 1] + r["level"] - 1] = r["n"]
    return out
