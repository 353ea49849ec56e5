"""Comparison patterns: distinct vectors of levels, their counts, and weights over them.

Pairs are rows (row_id, col_id, gamma), gamma being an array of levels with 0 for missing.
Patterns number at most the product of (levels + 1), whatever the data, so estimates work
on the pattern table and go back to pairs by an equi-join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def compare(pairs: DataFrame, row_id: str, col_id: str, levels: list[Column]) -> DataFrame:
    return pairs.select(F.col(row_id).alias("row_id"), F.col(col_id).alias("col_id"), F.array(*[x.cast("int") for x in levels]).alias("gamma"))


def patterns(pairs: DataFrame) -> DataFrame:
    """(pattern_id, gamma, n), numbered by gamma."""
    return numbered(pairs.groupBy("gamma").agg(F.count(F.lit(1)).alias("n")))


def numbered(counts: DataFrame) -> DataFrame:
    """(pattern_id, gamma, n) from (gamma, n)."""
    return counts.select(F.dense_rank().over(Window.orderBy("gamma")).alias("pattern_id"), "gamma", "n")


def level_counts(pats: DataFrame, nlevels: list[int]) -> DataFrame:
    """(field, level, n) of observed levels, zero counts too; fields and levels from 1."""
    spark = pats.sparkSession
    every = spark.createDataFrame([(k + 1, v) for k, n in enumerate(nlevels) for v in range(1, n + 1)], "field int, level int")
    seen = pats.select(F.posexplode("gamma").alias("k", "level"), "n").groupBy((F.col("k") + 1).alias("field"), "level").agg(F.sum("n").alias("n"))
    return every.join(seen, ["field", "level"], "left").select("field", "level", F.coalesce("n", F.lit(0)).alias("n"))


def field_counts(pats: DataFrame) -> DataFrame:
    """(field, n_obs, n_missing)."""
    one = pats.select(F.posexplode("gamma").alias("k", "level"), "n")
    return one.groupBy((F.col("k") + 1).alias("field")).agg(F.sum(F.when(F.col("level") > 0, F.col("n")).otherwise(0)).alias("n_obs"), F.sum(F.when(F.col("level") == 0, F.col("n")).otherwise(0)).alias("n_missing"))


def merge_candidates(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of two candidate sets, and the pairs on whose vectors they disagree (in neither result twice)."""
    both = a.unionByName(b).groupBy("row_id", "col_id").agg(F.min("gamma").alias("gamma"), F.max("gamma").alias("other"))
    return both.where("gamma = other").drop("other"), both.where("gamma <> other").select("row_id", "col_id")


def permute(pairs: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Pairs with ids replaced by maps (old, new)."""
    return pairs.join(rows.toDF("row_id", "new_row"), "row_id").join(cols.toDF("col_id", "new_col"), "col_id").select(F.col("new_row").alias("row_id"), F.col("new_col").alias("col_id"), "gamma")


def log_ratios(m: list[float], u: list[float]) -> list[float]:
    """log(pM / pU) by level of a field, 0 (missing) first; -inf or inf where a probability is 0."""
    return [0.0] + [math.log(x / y) if x > 0 and y > 0 else (0.0 if x == y else -math.inf if x <= 0 else math.inf) for x, y in zip(m, u)]


def weight(gamma: str, p_m: list[list[float]], p_u: list[list[float]]) -> Column:
    """Sum of log(pM / pU) over the observed fields; -inf or inf where a probability is 0."""
    total = F.lit(0.0)
    for k, (m, u) in enumerate(zip(p_m, p_u)):
        level = F.when(F.col(gamma)[k] == 0, 0.0)
        for v, value in enumerate(log_ratios(m, u)[1:], 1):
            level = level.when(F.col(gamma)[k] == v, value)
        total = total + level
    return total


def pair_weights(pairs: DataFrame, p_m, p_u, penalty: float | None = None) -> DataFrame:
    """(row_id, col_id, w); with a penalty, only pairs above it, less the penalty."""
    out = pairs.select("row_id", "col_id", weight("gamma", p_m, p_u).alias("w"))
    return out if penalty is None else out.where(F.col("w") > penalty).withColumn("w", F.col("w") - penalty)


def maximum_weights(pats: DataFrame, params: list[tuple]) -> DataFrame:
    """(pattern_id, w): each pattern's largest weight over several (pM, pU)."""
    ws = [weight("gamma", m, u) for m, u in params]
    return pats.select("pattern_id", (F.greatest(*ws) if len(ws) > 1 else ws[0]).alias("w"))


def costs(weights: DataFrame, shrunk: bool = False) -> DataFrame:
    """(row_id, col_id, cost): largest weight less a pair's own where that is positive; ``shrunk``: less the row's least."""
    top = weights.agg(F.greatest(F.max("w"), F.lit(0.0)).alias("top"))
    out = weights.join(F.broadcast(top)).select("row_id", "col_id", (F.col("top") - F.greatest("w", F.lit(0.0))).alias("cost"))
    return out.withColumn("cost", F.col("cost") - F.min("cost").over(Window.partitionBy("row_id"))) if shrunk else out


def minimum_margin(values: DataFrame, column: str, least: float = 0.0, digits: int = 5) -> float:
    """Smallest gap between distinct rounded values of a pattern-sized table, at least ``least``."""
    x = sorted({r[0] for r in values.select(F.round(column, digits)).distinct().collect() if r[0] is not None and math.isfinite(r[0])})
    return max(least, min((b - a for a, b in zip(x, x[1:])), default=least))


def pair_maximum_weights(pairs: DataFrame, params: list[tuple]) -> DataFrame:
    """(row_id, col_id, w): each pair's largest weight over several (pM, pU)."""
    ws = [weight("gamma", m, u) for m, u in params]
    return pairs.select("row_id", "col_id", (F.greatest(*ws) if len(ws) > 1 else ws[0]).alias("w"))


def edges_above(pairs: DataFrame, p_m, p_u, penalty: float) -> DataFrame:
    """(row_id, col_id) of pairs that weigh more than the penalty."""
    return pairs.where(weight("gamma", p_m, p_u) > penalty).select("row_id", "col_id")


def pair_costs(pairs: DataFrame, p_m, p_u, penalty: float = 0.0, shrunk: bool = False) -> DataFrame:
    """``costs`` of weights less the penalty: pairs at or below it cost as much as no link."""
    return costs(pairs.select("row_id", "col_id", (weight("gamma", p_m, p_u) - penalty).alias("w")), shrunk)


def check_candidates(pairs: DataFrame) -> DataFrame:
    """``pairs`` as they are; a ValueError if a pair is there twice or fields differ in number."""
    twice = pairs.groupBy("row_id", "col_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"pair ({twice[0][0]}, {twice[0][1]}) is there more than once")
    if pairs.select(F.size("gamma")).distinct().limit(2).count() > 1:
        raise ValueError("pairs have different numbers of fields")
    return pairs


def match_counts(links: DataFrame, pairs: DataFrame, nlevels: list[int], above: tuple | None = None) -> DataFrame:
    """(field, level, n, n_obs) for every level, zeros too: links at the level, and in the field with any.

    ``above``: (pM, pU, threshold); only links whose pattern weighs more than the threshold count.
    """
    kept = pairs if above is None else pairs.where(weight("gamma", above[0], above[1]) > above[2])
    every = pairs.sparkSession.createDataFrame([(k + 1, v) for k, n in enumerate(nlevels) for v in range(1, n + 1)], "field int, level int")
    counts = every.join(link_level_counts(links, kept), ["field", "level"], "left").select("field", "level", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("n_obs", F.sum("n").over(Window.partitionBy("field")))


def link_modes(links: DataFrame, pairs: DataFrame, pats: DataFrame, nlevels: list[int], pseudo: float = 0.0, above: tuple | None = None) -> DataFrame:
    """(field, level, p_m, p_u): ``max_mu`` as a table, from links (those above a weight with ``above``) and pattern counts."""
    both = match_counts(links, pairs, nlevels, above).join(level_counts(pats, nlevels).withColumnRenamed("n", "total"), ["field", "level"])
    each = Window.partitionBy("field")
    def share(n: Column) -> Column:
        top = F.sum(n + pseudo).over(each)
        return F.when(top > 0, (n + pseudo) / top).otherwise(1 / F.count(F.lit(1)).over(each))

    return both.select("field", "level", share(F.col("n")).alias("p_m"), share(F.col("total") - F.col("n")).alias("p_u"))


def prior_modes(spark, prior: list[list[float]]) -> DataFrame:
    """(field, level, p): a prior's shares by field."""
    rows = spark.createDataFrame([(k + 1, v, float(x)) for k, xs in enumerate(prior) for v, x in enumerate(xs, 1)], "field int, level int, x double")
    return rows.select("field", "level", (F.col("x") / F.sum("x").over(Window.partitionBy("field"))).alias("p"))


def nonzero_counts(table: DataFrame, value: str = "counts") -> DataFrame:
    """(row_id, col_id, n) or (row_id, col_id, stage, n) of the nonzero cells of rows (row_id, array) or (row_id, array of arrays), from 1."""
    nested = table.schema[value].dataType.elementType.typeName() == "array"
    cells = table.select("row_id", F.posexplode(value).alias("c", "x"))
    if nested:
        cells = cells.select("row_id", "c", F.posexplode("x").alias("s", "x"))
    at = [(F.col("c") + 1).alias("col_id")] + ([(F.col("s") + 1).alias("stage")] if nested else [])
    return cells.where("x <> 0").select("row_id", *at, F.col("x").alias("n"))


def link_level_counts(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, level, n) over linked pairs, missing levels left out."""
    one = links.join(pairs, ["row_id", "col_id"]).groupBy("gamma").count().select(F.posexplode("gamma").alias("k", "level"), "count")
    return one.where("level > 0").groupBy((F.col("k") + 1).alias("field"), "level").agg(F.sum("count").alias("n"))


def infer_nlevels(pats: DataFrame) -> DataFrame:
    """(field, nlevels): the largest level seen in each field."""
    return pats.select(F.posexplode("gamma").alias("k", "level")).groupBy((F.col("k") + 1).alias("field")).agg(F.max("level").alias("nlevels"))


def level_index(nlevels: list[int]) -> list[int]:
    """By field, how many levels the fields before it have; adding a level gives its place among all levels."""
    return [sum(nlevels[:k]) for k in range(len(nlevels))]


def pattern_levels(pats: DataFrame, nlevels: list[int]) -> DataFrame:
    """(pattern_id, level_idx): the design matrix by its ones; missing fields have none."""
    start = F.array(*[F.lit(x) for x in level_index(nlevels)])
    return pats.select("pattern_id", F.posexplode("gamma").alias("k", "level")).where("level > 0").select("pattern_id", (F.element_at(start, F.col("k") + 1) + F.col("level")).alias("level_idx"))


def pattern_observed(pats: DataFrame) -> DataFrame:
    """(pattern_id, observed): 0 or 1 by field."""
    return pats.select("pattern_id", F.transform("gamma", lambda g: (g != 0).cast("int")).alias("observed"))


def linked_patterns(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gamma, n): how many links each pattern has; those without a link are left out."""
    return pairs.join(links.select("row_id", "col_id"), ["row_id", "col_id"], "left_semi").groupBy("gamma").agg(F.count(F.lit(1)).alias("n"))


def midpoints(values: DataFrame, column: str) -> DataFrame:
    """(mid): halfway between neighbouring distinct values of a pattern-sized table."""
    step = Window.orderBy(column)
    return values.select(column).distinct().select(((F.col(column) + F.lead(column).over(step)) / 2).alias("mid")).where("mid IS NOT NULL")


#: Pattern tables are bounded by the product of (levels + 1); larger ones are refused where they would come to the driver.
MAX_PATTERNS = 1_000_000


def collected(pats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Gammas and counts of a pattern table, by gamma: bounded by the levels, not by the data."""
    if pats.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns: use fewer fields or levels")
    rows = sorted((tuple(r["gamma"]), r["n"]) for r in pats.select("gamma", "n").collect())
    return np.array([g for g, _ in rows], dtype=int), np.array([n for _, n in rows], dtype=float)


def _design(gammas: np.ndarray, nlevels: list[int]) -> np.ndarray:
    """One row a pattern, one column a (field, level); missing fields are all zero."""
    return np.concatenate([(gammas[:, [k]] == np.arange(1, n + 1)).astype(float) for k, n in enumerate(nlevels)], axis=1)


def _normalised(x: np.ndarray, nlevels: list[int]) -> np.ndarray:
    out, at = np.empty_like(x, dtype=float), 0
    for n in nlevels:
        s = x[at : at + n].sum()
        out[at : at + n] = x[at : at + n] / s if s > 0 else 1 / n
        at += n
    return out


def split_fields(x: np.ndarray, nlevels: list[int]) -> list[list[float]]:
    return [list(map(float, p)) for p in np.split(x, np.cumsum(nlevels)[:-1])]


def prior_mean(prior: np.ndarray, nlevels: list[int]) -> np.ndarray:
    return _normalised(np.asarray(prior, dtype=float), nlevels)


def e_step(pats: DataFrame, p_m, p_u, p: float) -> DataFrame:
    """(pattern_id, gamma, n, g_m, g_u): each pattern's share of matches and of others."""
    odds = F.lit(math.log(p / (1 - p))) + weight("gamma", p_m, p_u)
    return pats.select("pattern_id", "gamma", "n", (1 / (1 + F.exp(-odds))).alias("g_m")).withColumn("g_u", 1 - F.col("g_m"))


def m_step(shares: DataFrame, nlevels: list[int], pseudo: float | None = None) -> tuple[DataFrame, float]:
    """(field, level, p_m, p_u) and the share of matches, given ``e_step``, with ``pseudo`` counts (1 / levels by default)."""
    start = [(k + 1, v, 1 / n if pseudo is None else pseudo) for k, n in enumerate(nlevels) for v in range(1, n + 1)]
    every = shares.sparkSession.createDataFrame(start, "field int, level int, extra double")
    one = shares.select(F.posexplode("gamma").alias("k", "level"), (F.col("n") * F.col("g_m")).alias("m"), (F.col("n") * F.col("g_u")).alias("u"))
    seen = one.groupBy((F.col("k") + 1).alias("field"), "level").agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    both = every.join(seen, ["field", "level"], "left")
    each = Window.partitionBy("field")
    part = lambda c: (F.coalesce(c, F.lit(0.0)) + F.col("extra")) / F.sum(F.coalesce(c, F.lit(0.0)) + F.col("extra")).over(each)
    share = shares.agg(F.sum(F.col("n") * F.col("g_m")) / F.sum("n")).first()[0]
    return both.select("field", "level", part("m").alias("p_m"), part("u").alias("p_u")), share


def estimate_em(pats: DataFrame, p_m: np.ndarray, p_u: np.ndarray, p: float, nlevels: list[int], pseudo: float | None = None, tol: float = 1e-6, max_iter: int = 5000) -> dict:
    """Two-class mixture by EM on the pattern table, with ``pseudo`` counts (1 / levels by default)."""
    gammas, n = collected(pats)
    x = _design(gammas, nlevels)
    extra = np.concatenate([np.full(k, 1 / k if pseudo is None else pseudo) for k in nlevels])
    p_m, p_u = np.asarray(p_m, dtype=float), np.asarray(p_u, dtype=float)
    for step in range(1, max_iter + 1):
        with np.errstate(divide="ignore"):
            z = x @ (np.log(p_m) - np.log(p_u)) + math.log(p / (1 - p))
        g = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        new_m, new_u = _normalised(x.T @ (n * g) + extra, nlevels), _normalised(x.T @ (n * (1 - g)) + extra, nlevels)
        new_p = float(np.clip((n * g).sum() / n.sum(), 1e-12, 1 - 1e-12))
        moved = np.abs(new_m - p_m).max() + np.abs(new_u - p_u).max() + abs(new_p - p)
        p_m, p_u, p = new_m, new_u, new_p
        if moved < tol:
            return {"p_m": p_m, "p_u": p_u, "p": p, "iterations": step, "converged": True}
    return {"p_m": p_m, "p_u": p_u, "p": p, "iterations": max_iter, "converged": False}


def max_mu(linked: np.ndarray, total: np.ndarray, nlevels: list[int], pseudo_m: np.ndarray, pseudo_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior modes given level counts of the links and of all pairs."""
    return _normalised(linked + pseudo_m, nlevels), _normalised(total - linked + pseudo_u, nlevels)
