"""Penalised-likelihood estimates and the path of them under rising penalties.

Pairs are numbered by pattern and staged when a fit first weighs their pattern above its penalty; an
iteration reweighs the patterns and joins them to pairs.  Matchings are found by component, so what is best as a whole is best by
component too.  Pattern tables are bounded by the levels (``patterns.MAX_PATTERNS``).
"""

from __future__ import annotations

import functools
import logging

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pairloom.operators import linkage as L, patterns as P
from pairloom.operators.blocking import Blocked, Folded
from pairloom.plans.staging import stage

log = logging.getLogger("pairloom.search")


class Patterned:
    """Pairs by pattern: the patterns' design matrix, their numbers of pairs, and the pairs of those patterns that were asked for.

    ``source`` is a table of pairs (row_id, col_id, gamma) or ``Blocked`` files, whose equal rows and columns are
    taken as one.  Only pairs of patterns that may be linked are stored; a pattern not asked for before is added.
    """

    def __init__(self, source: DataFrame | Blocked, nlevels: list[int]):
        self.nlevels, self.folded = nlevels, None
        if isinstance(source, Blocked):
            self.folded = Folded(source)
            pats, self._source = source.patterns(), lambda: self.folded.counted(self.folded.files.pairs().select("row_id", "col_id", "gamma"))
        else:
            staged = stage(source.select("row_id", "col_id", "gamma"), "pairs")
            pats, self._source = P.patterns(staged), lambda: staged.withColumns({"n_row": F.lit(1).cast("long"), "n_col": F.lit(1).cast("long")})
        self.gammas, self.n = P.collected(pats)
        self.spark = pats.sparkSession
        self.design = P._design(self.gammas, nlevels) if len(self.gammas) else np.zeros((0, sum(nlevels)))
        self.total = self.design.T @ self.n
        self.prices, self._held, self._stored = None, [], []

    def pairs(self, wanted: np.ndarray) -> DataFrame:
        """(row_id, col_id, n_row, n_col, pattern) of at least the patterns ``wanted``."""
        more = [int(i) for i in wanted if int(i) not in self._held]
        if more or not self._stored:
            table = self.spark.createDataFrame([([int(v) for v in self.gammas[i]], i) for i in more], "gamma array<int>, pattern long")
            self._stored.append(stage(self._source().join(F.broadcast(table), "gamma").select("row_id", "col_id", "n_row", "n_col", "pattern"), "patterned"))
            self._held += more
        return functools.reduce(DataFrame.unionByName, self._stored)

    def links(self, flows: DataFrame) -> DataFrame:
        """(row_id, col_id, w) of single rows and columns."""
        return flows.drop("n") if self.folded is None else self.folded.links(flows)

    def weights(self, p_m: np.ndarray, p_u: np.ndarray) -> np.ndarray:
        """Of each pattern; -inf or inf where a probability of an observed level is 0, and 0 for a level that neither has."""
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where((p_m == 0) & (p_u == 0), 0.0, np.log(p_m) - np.log(p_u))
            return np.where(self.design > 0, ratio, 0.0).sum(axis=1)

    def matched(self, p_m: np.ndarray, p_u: np.ndarray, penalty: float, solver: str) -> tuple[DataFrame, np.ndarray]:
        """The best links under a penalty, staged (``links`` tells them one by one), and how many each pattern has."""
        w = self.weights(p_m, p_u)
        over = np.flatnonzero(w > penalty)
        above = self.spark.createDataFrame([(int(i), float(w[i] - penalty)) for i in over], "pattern long, w double")
        weighed = self.pairs(over).join(F.broadcast(above), "pattern").drop("pattern")
        if solver == "recycled":
            flows, self.prices = L.flows_recycled(weighed, self.prices)
        else:
            flows = stage(L.flows(weighed, solver), "flows")
        counts = np.zeros(len(self.n))
        for r in self.pairs(over).join(flows.select("row_id", "col_id", "n"), ["row_id", "col_id"]).groupBy("pattern").agg(F.sum("n").alias("n")).collect():
            counts[r["pattern"]] = r["n"]
        return flows, counts

    def modes(self, counts: np.ndarray, prior_m: np.ndarray, prior_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return P.max_mu(self.design.T @ counts, self.total, self.nlevels, np.asarray(prior_m) - 1, np.asarray(prior_u) - 1)


def fit(pairs: DataFrame | Blocked | Patterned, nlevels: list[int], p_m, p_u, prior_m, prior_u, penalty: float, max_iter: int = 100, solver: str = "hungarian", settle: str = "parameters", tol: float = 1e-12) -> dict:
    """Alternate the best matching under a penalty and the modes given it, until nothing changes; priors above 1.

    ``settle``: "parameters" stops when no mode moves by more than ``tol``, "counts" when the
    level counts of the links repeat.  ``solver``: "hungarian", "auction", or "recycled", an auction that goes on
    from the prices of the iteration (and fit) before.  ``converged`` tells whether that came before ``max_iter``.
    """
    data = pairs if isinstance(pairs, Patterned) else Patterned(pairs, nlevels)
    p_m, p_u = np.asarray(p_m, dtype=float), np.asarray(p_u, dtype=float)
    before = None
    for step in range(1, max_iter + 1):
        flows, counts = data.matched(p_m, p_u, penalty, solver)
        new_m, new_u = data.modes(counts, prior_m, prior_u)
        levels = data.design.T @ counts
        moved = max(np.abs(new_m - p_m).max(initial=0.0), np.abs(new_u - p_u).max(initial=0.0))
        done = moved <= tol if settle == "parameters" else before is not None and (levels == before).all()
        p_m, p_u, before = new_m, new_u, levels
        if done:
            break
    return {"links": data.links(flows), "counts": counts, "p_m": p_m, "p_u": p_u, "iterations": step, "converged": bool(done)}


def next_penalty(weights, penalty: float, mininc: float, frac: float = 0.5, matched=None) -> tuple[float, int]:
    """The next penalty and how many pattern weights are above it.

    It is past the least weight above ``penalty`` (of ``matched`` patterns, if given) and not below
    penalty + mininc: ``frac`` of the way between the weights on both sides of the larger of
    those two.  Without any weight above penalty + mininc: that sum, and 0.
    """
    above = sorted(float(w) for w in weights if w > penalty)
    if matched is not None:
        least = min(matched, default=None)
        if least is None or max(matched) <= penalty + mininc:
            return penalty + mininc, 0
    else:
        least = above[0] if above else None
    bound = penalty + mininc if least is None else max(penalty + mininc, float(least))
    over = [i for i, w in enumerate(above) if w > bound]
    if not over:
        return bound, 0
    i = over[0]
    return (bound if i == 0 else max((1 - frac) * above[i - 1] + frac * above[i], bound)), len(above) - i


def search(pairs: DataFrame | Blocked, nlevels: list[int], p_m, p_u, prior_m, prior_u, penalty: float = 0.0, mininc: float = 0.1, max_iter: int = 100, solver: str = "hungarian") -> dict:
    """Fits under rising penalties, each started from the one before, until no pattern weighs more than the next.

    The next penalty passes the least weight of a linked pattern; links that fall below it are left out of the
    modes that the next fit starts from.  Every fit is logged with its links and the patterns above.  Result:
    ``steps`` (a dict each: step, penalty, n_links, iterations, converged, n_above the next penalty, p_m, p_u),
    and ``trace``: (row_id, col_id, start, stop), the steps between which a link stood.
    A ValueError for ``mininc`` below 0, and if the penalty can't rise.
    """
    if mininc < 0:
        raise ValueError("mininc has to be 0 or more")
    data, steps, each = Patterned(pairs, nlevels), [], None
    while True:
        found = fit(data, nlevels, p_m, p_u, prior_m, prior_u, penalty, max_iter, solver)
        w = data.weights(found["p_m"], found["p_u"])
        after, n_above = next_penalty(w, penalty, mininc, matched=w[found["counts"] > 0])
        steps.append({"step": len(steps) + 1, "penalty": float(penalty), "n_links": int(found["counts"].sum()), "n_above": n_above, **{k: found[k] for k in ("iterations", "converged", "p_m", "p_u")}})
        log.info("penalty: %s, matches: %s, above: %s", penalty, steps[-1]["n_links"], n_above)
        standing = found["links"].select("row_id", "col_id", F.lit(len(steps)).alias("step"))
        each = standing if each is None else each.unionByName(standing)
        if not n_above:
            return {"steps": steps, "trace": stage(L.intervals(each), "trace")}
        if after <= penalty:
            raise ValueError("the penalty doesn't rise: mininc has to be above 0 here")
        p_m, p_u = data.modes(np.where(w > after, found["counts"], 0.0), prior_m, prior_u)
        penalty = after
