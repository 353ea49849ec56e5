"""Scalar column functions: comparators, pair indexes, balancing functions and priors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty strings, null where either is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def similarity_most(a: Column, b: Column) -> Column:
    """At least ``similarity``, from equality and lengths alone; null where either is null."""
    longer, gap = F.greatest(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    return F.when(a == b, 1.0).when(a != b, 1 - F.greatest(gap, F.lit(1)) / longer)


def ordinal_level(a: Column, b: Column, cuts: tuple[float, ...] = (1.0, 0.75, 0.5)) -> Column:
    """1 for a similarity of at least the first cut, 2 for the second, ...; 0 where either is null."""
    sim, level = similarity(a, b), F.lit(len(cuts) + 1)
    for k in range(len(cuts), 0, -1):
        level = F.when(sim >= cuts[k - 1], k).otherwise(level)
    return F.when(a.isNull() | b.isNull(), 0).otherwise(level)


def similarity_level(sim: Column, cuts: tuple[float, ...] = (1.0, 0.75, 0.5)) -> Column:
    """``ordinal_level`` of a similarity; 0 for null."""
    level = F.lit(len(cuts) + 1)
    for k in range(len(cuts), 0, -1):
        level = F.when(sim >= cuts[k - 1], k).otherwise(level)
    return F.when(sim.isNull(), 0).otherwise(level)


def gap_level(gap: Column, cuts: tuple[float, ...]) -> Column:
    """``distance_level`` of a distance; 0 for null."""
    level = F.lit(len(cuts) + 1)
    for k in range(len(cuts), 0, -1):
        level = F.when(gap < cuts[k - 1], k).otherwise(level)
    return F.when(gap.isNull(), 0).otherwise(level)


def exact_level(a: Column, b: Column, missing: str | None = None) -> Column:
    """1 if equal, 2 if not, 0 where either is null or the text ``missing`` (as "NA" in delimited files)."""
    absent = a.isNull() | b.isNull()
    if missing is not None:
        absent = absent | (a == missing) | (b == missing)
    return F.when(absent, 0).when(a == b, 1).otherwise(2)


def similar_any(pairs: list[tuple[Column, Column]], above: float = 0.6) -> Column:
    """Candidate predicate: the similarity in any field is above ``above``; a field with a null isn't."""
    found = F.lit(False)
    for a, b in pairs:
        found = found | F.coalesce(similarity(a, b) > above, F.lit(False))
    return found


def distance_level(a: Column, b: Column, cuts: tuple[float, ...]) -> Column:
    """1 below the first cut of |a - b|, 2 below the second, ...; 0 where either is null."""
    level = F.lit(len(cuts) + 1)
    for k in range(len(cuts), 0, -1):
        level = F.when(F.abs(a - b) < cuts[k - 1], k).otherwise(level)
    return F.when(a.isNull() | b.isNull(), 0).otherwise(level)


def pair_to_index(row: Column, col: Column, nrow: int) -> Column:
    return (col - 1) * nrow + row


def index_to_pair(index: Column, nrow: int) -> tuple[Column, Column]:
    return (index - 1) % nrow + 1, F.floor((index - 1) / nrow) + 1


def posterior(weight: Column, p: float) -> Column:
    """Match probability from a log weight and a prior share of matches."""
    return 1 / (1 + F.exp(-(F.lit(math.log(p / (1 - p))) + weight)))


def shrink_all(weights: Column, threshold: float) -> Column:
    """``shrink`` of every element of an array; nulls stay null."""
    return F.transform(weights, lambda w: F.when(w.isNotNull(), shrink(w, threshold)))


def shrink(weight: Column, threshold: float) -> Column:
    return F.greatest(weight - threshold, F.lit(0.0))


def _log1p_exp(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


#: Balancing functions: of a ratio (t), of its logarithm, and from logarithm to logarithm.
BALANCING = {
    "sqrt": F.sqrt, "sqrt_logx": lambda x: F.exp(0.5 * x), "lsqrt": lambda x: 0.5 * x,
    "barker": lambda t: t / (1 + t), "barker_logx": lambda x: 1 / (1 + F.exp(-x)), "lbarker": lambda x: x - _log1p_exp(x),
    "min1": lambda t: F.least(t, F.lit(1.0)), "min1_logx": lambda x: F.least(F.exp(x), F.lit(1.0)), "lmin1": lambda x: F.least(x, F.lit(0.0)),
    "max1": lambda t: F.greatest(t, F.lit(1.0)), "max1_logx": lambda x: F.greatest(F.exp(x), F.lit(1.0)), "lmax1": lambda x: F.greatest(x, F.lit(0.0)),
}


def exppenalty_logprior(nlink: Column, theta: float) -> Column:
    return -theta * nlink


def exppenalty_logratio(n1: Column, n2: Column, theta: float) -> Column:
    return theta * (n2 - n1)


def exppenalty_prior(nlink: Column, theta: float) -> Column:
    return F.exp(exppenalty_logprior(nlink, theta))


def exppenalty_ratio(n1: Column, n2: Column, theta: float) -> Column:
    """Prior of n1 links over that of n2; 1 for equal counts."""
    return F.exp(exppenalty_logratio(n1, n2, theta))


def exppenalty_logratiopn(nadd: Column, theta: float) -> Column:
    """Log prior of ``nadd`` links more, whatever their number, less that of none more."""
    return -theta * nadd


def exppenalty_ratiopn(nadd: Column, theta: float) -> Column:
    return F.exp(exppenalty_logratiopn(nadd, theta))


def betabipartite_logprior(nlink: int, nrow: int, ncol: int, alpha: float, beta: float) -> float:
    """Log prior of one set of ``nlink`` links: uniform given its size, the size beta-binomial."""
    big, small = max(nrow, ncol), min(nrow, ncol)
    g = math.lgamma
    lbeta = lambda a, b: g(a) + g(b) - g(a + b)
    return g(big - nlink + 1) - g(big + 1) + lbeta(nlink + alpha, small - nlink + beta) - lbeta(alpha, beta)


def betabipartite_prior(nlink: int, nrow: int, ncol: int, alpha: float, beta: float) -> float:
    return math.exp(betabipartite_logprior(nlink, nrow, ncol, alpha, beta))


def betabipartite_logratio(n1: int, n2: int, nrow: int, ncol: int, alpha: float, beta: float) -> float:
    """Log prior of n1 links less that of n2; 0 for equal counts."""
    return 0.0 if n1 == n2 else betabipartite_logprior(n1, nrow, ncol, alpha, beta) - betabipartite_logprior(n2, nrow, ncol, alpha, beta)


def betabipartite_ratio(n1: int, n2: int, nrow: int, ncol: int, alpha: float, beta: float) -> float:
    return math.exp(betabipartite_logratio(n1, n2, nrow, ncol, alpha, beta))


def betabipartite_logratiopn(nadd: int, nlink: int, nrow: int, ncol: int, alpha: float, beta: float) -> float:
    """Log prior of ``nadd`` links more than ``nlink``, less that of ``nlink``."""
    return betabipartite_logratio(nlink + nadd, nlink, nrow, ncol, alpha, beta)


def betabipartite_ratiopn(nadd: int, nlink: int, nrow: int, ncol: int, alpha: float, beta: float) -> float:
    return math.exp(betabipartite_logratiopn(nadd, nlink, nrow, ncol, alpha, beta))


def betabipartite_ratios(spark: SparkSession, nrow: int, ncol: int, alpha: float, beta: float, base: int = 0, nadd: int = 1) -> DataFrame:
    """(nlink, prior, logratio, ratio, logratiopn, ratiopn): ratios to ``base`` links, and for ``nadd`` more (null past the last)."""
    own, most = (nrow, ncol, alpha, beta), min(nrow, ncol)
    rows = []
    for n in range(most + 1):
        more = betabipartite_logratiopn(nadd, n, *own) if 0 <= n + nadd <= most else None
        rows.append((n, betabipartite_prior(n, *own), betabipartite_logratio(n, base, *own), betabipartite_ratio(n, base, *own), more, None if more is None else math.exp(more)))
    return spark.createDataFrame(rows, "nlink long, prior double, logratio double, ratio double, logratiopn double, ratiopn double")


def betabipartite_table(spark: SparkSession, nrow: int, ncol: int, alpha: float, beta: float) -> DataFrame:
    """(nlink, logprior, logratio_add) for every possible number of links; the last has no ratio."""
    most = min(nrow, ncol)
    values = [betabipartite_logprior(n, nrow, ncol, alpha, beta) for n in range(most + 1)]
    rows = [(n, values[n], values[n + 1] - values[n] if n < most else None) for n in range(most + 1)]
    return spark.createDataFrame(rows, "nlink long, logprior double, logratio_add double")
