"""Queries registered by the library's own operators, and their SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import registry_more
from pairloom.functions import columns as C, levels as V
from pairloom.operators import blocks as B, linkage as L, mcmc, patterns as P
from pairloom.operators.blocking import Blocked, Field, Folded
from pairloom.plans.staging import new_path, stage
from pairloom.sources import store

FLAGSHIP = "patterns_customer_supplier"
NLEVELS = [4, 3]
#: Probabilities used where a query takes them as given, by field and level.
P_M = [[0.6, 0.1, 0.2, 0.1], [0.6, 0.3, 0.1]]
P_U = [[0.01, 0.04, 0.05, 0.9], [0.1, 0.3, 0.6]]
_LOG = [[np.log(m / u) for m, u in zip(a, b)] for a, b in zip(P_M, P_U)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> Blocked:
    """Customers and suppliers of one nation (the block), compared by the number in the name and by balance (missing if negative)."""
    number = lambda c: F.regexp_replace(c, "^[^#]*#0*", "")
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("block"), number("c_name").alias("x0"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("x1"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("col_id"), F.col("s_nationkey").alias("block"), number("s_name").alias("y0"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("y1"))
    return Blocked(a, b, [Field(C.similarity, C.similarity_level, C.similarity_most, V.Similar()), Field(lambda x, y: F.abs(x - y), lambda gap: C.gap_level(gap, (100.0, 1000.0)), grid=V.Near((100.0, 1000.0)))])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).pairs()


def _weights(spark, d, penalty=None):
    return P.pair_weights(pairs(spark, d) if penalty is None else files(spark, d).above(P_M, P_U, penalty), P_M, P_U, penalty)


def folded_edges(spark, d) -> tuple[Folded, DataFrame]:
    """Folded files, and the pairs of them that weigh more than 1: (row_id, col_id, w, n_row, n_col), w less 1."""
    folded = Folded(files(spark, d))
    return folded, folded.counted(P.pair_weights(folded.files.above(P_M, P_U, 1.0), P_M, P_U, 1.0))


def _labelled(spark, d) -> DataFrame:
    folded, edges = folded_edges(spark, d)
    return folded.expanded(L.bipartite_components(edges)).select("row_id", "col_id", "label")


def _sizes(spark, d) -> DataFrame:
    return L.component_sizes(stage(L.bipartite_components(folded_edges(spark, d)[1]), "labelled"))


def _assigned(spark, d, solver) -> DataFrame:
    folded, edges = folded_edges(spark, d)
    return folded.links(stage(L.flows(edges, solver), "flows"))


def _rising_blocks(spark, d) -> DataFrame:
    folded = Folded(files(spark, d))
    weighed = folded.counted(P.pair_weights(folded.files.above(P_M, P_U, 0.5), P_M, P_U))
    return folded.expanded(L.blocks(weighed, 30, 0.5, 1.0))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _links(spark, d, k: int) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("row_id"), (F.col("o_orderkey") % k).alias("col_id")).distinct()


def _trace(spark, d) -> DataFrame:
    return _t(spark, d, "events").select((F.col("user_id") % 50).alias("row_id"), F.length("event_type").cast("long").alias("col_id"), (F.col("event_id") % 100 + 1).cast("int").alias("start"), (F.col("event_id") % 100 + 1 + F.col("event_id") % 7).cast("int").alias("stop"))


def _em(spark, d):
    fit = P.estimate_em(files(spark, d).patterns(), np.concatenate(P_M), np.concatenate(P_U), 0.01, NLEVELS)
    at = [(k + 1, v + 1) for k, n in enumerate(NLEVELS) for v in range(n)]
    return spark.createDataFrame([(f, v, float(m), float(u)) for (f, v), m, u in zip(at, fit["p_m"], fit["p_u"])], "field int, level int, p_m double, p_u double")


def _sampled(spark, d, sampler, kernel):
    """Chains over all stored pairs whose row and column share a component; levels are counted over all pairs."""
    folded, edges = folded_edges(spark, d)
    nodes = stage(folded.nodes(L.bipartite_nodes(edges)), "nodes")
    inside = files(spark, d).labelled(nodes)
    totals = L._level_vector(P.level_counts(files(spark, d).patterns(), NLEVELS), NLEVELS)
    n = nodes.where("side = 'row'").select("id").distinct().count()
    return sampler(inside, NLEVELS, totals, np.ones(7), np.ones(7), [C.exppenalty_logprior(k, 1.0) for k in range(n + 2)], steps=200, chains=2, kernel=kernel)


def _stored(spark, d):
    path = new_path(spark, "summary")
    store.write_summary(pairs(spark, d), NLEVELS, path, pats=files(spark, d).patterns())
    return store.read_summary(spark, path)["pairs"]


def _indexed(found: DataFrame, nrow: int) -> DataFrame:
    index = found.select(C.pair_to_index(F.col("row_id") + 1, F.col("col_id") + 1, nrow).alias("index"))
    return index.select("index", *[c.cast("long").alias(n) for n, c in zip(("row_back", "col_back"), C.index_to_pair(F.col("index"), nrow))])


def _first_links(spark, d, k: int) -> DataFrame:
    """One column for each customer."""
    return _links(spark, d, k).groupBy("row_id").agg(F.min("col_id").alias("col_id"))


def _same_number(spark, d) -> DataFrame:
    rows = files(spark, d).rows
    return files(spark, d).at(rows.select("row_id", F.col("row_id").alias("col_id")).distinct()).select("row_id", "col_id")


_PAIRS = """WITH a AS (SELECT c_custkey, c_nationkey, regexp_replace(c_name, '^[^#]*#0*', '') AS x, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS p FROM customer),
 b AS (SELECT s_suppkey, s_nationkey, regexp_replace(s_name, '^[^#]*#0*', '') AS y, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS q FROM supplier),
 s AS (SELECT c_custkey AS row_id, s_suppkey AS col_id, 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE AS sim, abs(p - q) AS gap FROM a JOIN b ON c_nationkey = s_nationkey),
 pairs AS (SELECT row_id, col_id, CASE WHEN sim >= 1 THEN 1 WHEN sim >= 0.75 THEN 2 WHEN sim >= 0.5 THEN 3 ELSE 4 END AS g1,
                  CASE WHEN gap IS NULL THEN 0 WHEN gap < 100 THEN 1 WHEN gap < 1000 THEN 2 ELSE 3 END AS g2 FROM s)"""
_CASE = " + ".join(f"CASE g{k + 1} " + " ".join(f"WHEN {v + 1} THEN {x!r}e0" for v, x in enumerate(map(float, row))) + " ELSE 0 END" for k, row in enumerate(_LOG))
_WEIGHTS = f"{_PAIRS}, w AS (SELECT row_id, col_id, {_CASE} AS w FROM pairs)"
_TRACE = "WITH t AS (SELECT user_id % 50 AS row_id, length(event_type) AS col_id, event_id % 100 + 1 AS start, event_id % 100 + 1 + event_id % 7 AS stop FROM events)"
_L = "SELECT DISTINCT o_custkey AS row_id, o_orderkey % {} AS col_id FROM orders"
_COMPONENTS = f"""{_WEIGHTS.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT * FROM w WHERE w > 1),
 c AS (SELECT row_id, row_id AS label FROM e UNION SELECT f.row_id, c.label FROM c JOIN e ON c.row_id = e.row_id JOIN e f ON e.col_id = f.col_id),
 l AS (SELECT row_id, min(label) AS label FROM c GROUP BY row_id)"""

_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    FLAGSHIP: (
        lambda s, d: files(s, d).patterns().select("pattern_id", F.array_join(F.transform("gamma", lambda g: g.cast("string")), "|").alias("gamma"), "n"),
        f"{_PAIRS} SELECT row_number() OVER (ORDER BY g1, g2) AS pattern_id, g1 || '|' || g2 AS gamma, count(*) AS n FROM pairs GROUP BY g1, g2",
    ),
    "level_counts": (
        lambda s, d: P.level_counts(files(s, d).patterns(), NLEVELS),
        f"{_PAIRS}, v AS (SELECT 1 AS field, unnest(range(1, 5)) AS level UNION ALL SELECT 2, unnest(range(1, 4))) SELECT field, level, (SELECT count(*) FROM pairs WHERE CASE field WHEN 1 THEN g1 ELSE g2 END = level) AS n FROM v",
    ),
    "field_counts": (
        lambda s, d: P.field_counts(files(s, d).patterns()),
        f"{_PAIRS} SELECT 1 AS field, count(*) FILTER (g1 > 0) AS n_obs, count(*) FILTER (g1 = 0) AS n_missing FROM pairs UNION ALL SELECT 2, count(*) FILTER (g2 > 0), count(*) FILTER (g2 = 0) FROM pairs",
    ),
    "pair_weights": (lambda s, d: _rounded(_weights(s, d), "w"), f"{_WEIGHTS} SELECT row_id, col_id, round(w, 6) AS w FROM w"),
    "penalized_weights": (lambda s, d: _rounded(_weights(s, d, 1.0), "w"), f"{_WEIGHTS} SELECT row_id, col_id, round(w - 1, 6) AS w FROM w WHERE w > 1"),
    "posterior": (
        lambda s, d: _weights(s, d).select("row_id", "col_id", F.round(C.posterior(F.col("w"), 0.01), 6).alias("p")),
        f"{_WEIGHTS} SELECT row_id, col_id, round(1 / (1 + exp(-(ln(0.01 / 0.99) + w))), 6) AS p FROM w",
    ),
    "costs_shrunk": (
        lambda s, d: _rounded(P.costs(_weights(s, d), shrunk=True), "cost"),
        f"{_WEIGHTS}, k AS (SELECT row_id, col_id, (SELECT greatest(max(w), 0) FROM w) - greatest(w, 0) AS cost FROM w) SELECT row_id, col_id, round(cost - min(cost) OVER (PARTITION BY row_id), 6) AS cost FROM k",
    ),
    "merge_candidates": (
        lambda s, d: P.merge_candidates(pairs(s, d).where("gamma[0] < 4"), pairs(s, d).where("gamma[0] > 2"))[0].select("row_id", "col_id", F.col("gamma")[0].alias("g1"), F.col("gamma")[1].alias("g2")),
        f"{_PAIRS} SELECT row_id, col_id, g1, g2 FROM pairs WHERE g1 < 4 UNION SELECT row_id, col_id, g1, g2 FROM pairs WHERE g1 > 2",
    ),
    "components": (_labelled, f"{_COMPONENTS} SELECT e.row_id, e.col_id, label FROM e JOIN l ON e.row_id = l.row_id"),
    "component_summary": (
        lambda s, d: L.summarise(_sizes(s, d)),
        f"""{_COMPONENTS}, z AS (SELECT label, count(DISTINCT e.row_id) AS r, count(DISTINCT col_id) AS c FROM e JOIN l ON e.row_id = l.row_id GROUP BY label)
        SELECT coalesce(sum(r * c), 0)::BIGINT AS n_pairs, coalesce(max(r * c), 0) AS max_pairs, coalesce(max(greatest(r, c)), 0) AS max_side, count(*) AS n_components, count(*) FILTER (r = 1 AND c = 1) AS n_singletons FROM z""",
    ),
    "blocks": (_rising_blocks, None),
    "assign_hungarian": (lambda s, d: _assigned(s, d, "hungarian"), None),
    "assign_auction": (lambda s, d: _assigned(s, d, "auction"), None),
    "em": (_em, None),
    "mcmc_trace": (lambda s, d: _sampled(s, d, mcmc.sample, "barker"), None),
    "mcmc_trace_uniform": (lambda s, d: _sampled(s, d, mcmc.sample, "uniform+gibbs"), None),
    "mcmc_trace_open_column": (lambda s, d: _sampled(s, d, mcmc.sample, "open_column"), None),
    "mcmc_counts": (lambda s, d: _sampled(s, d, mcmc.sample_counts, "barker+gibbs"), None),
    "mcmc_transitions": (lambda s, d: _sampled(s, d, mcmc.sample_transitions, "barker"), None),
    "mcmc_parameters": (lambda s, d: _sampled(s, d, mcmc.sample_parameters, "barker"), None),
    "link_level_counts": (
        lambda s, d: P.link_level_counts(pairs(s, d).where("row_id = col_id").select("row_id", "col_id"), pairs(s, d)),
        f"{_PAIRS} SELECT 1 AS field, g1 AS level, count(*) AS n FROM pairs WHERE row_id = col_id AND g1 > 0 GROUP BY g1 UNION ALL SELECT 2, g2, count(*) FROM pairs WHERE row_id = col_id AND g2 > 0 GROUP BY g2",
    ),
    "links_added": (lambda s, d: L.links_added(_links(s, d, 7), _links(s, d, 5)), f"({_L.format(7)}) EXCEPT ({_L.format(5)})"),
    "links_removed": (lambda s, d: L.links_removed(_links(s, d, 7), _links(s, d, 5)), f"({_L.format(5)}) EXCEPT ({_L.format(7)})"),
    "link_difference": (
        lambda s, d: L.link_difference(_links(s, d, 7), _links(s, d, 5)),
        f"SELECT *, 'added' AS change FROM (({_L.format(7)}) EXCEPT ({_L.format(5)})) UNION ALL SELECT *, 'removed' FROM (({_L.format(5)}) EXCEPT ({_L.format(7)}))",
    ),
    "link_counts": (lambda s, d: L.link_counts(_trace(s, d), 20), f"{_TRACE} SELECT row_id, col_id, sum(stop - greatest(start, 21) + 1)::BIGINT AS n FROM t WHERE stop > 20 GROUP BY ALL"),
    "step_links": (lambda s, d: L.step_links(_trace(s, d), 40), f"{_TRACE} SELECT row_id, col_id FROM t WHERE start <= 40 AND stop >= 40"),
    "segment_links": (lambda s, d: L.segment_links(_trace(s, d), 40, 43), f"{_TRACE} SELECT row_id, col_id FROM t WHERE start <= 40 AND stop >= 43"),
    "group_counts": (
        lambda s, d: L.group_counts(_trace(s, d), s.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("gid"))),
        f"{_TRACE}, u AS (SELECT row_id % 4 AS gid, unnest(range(start, stop + 1)) AS step FROM t) SELECT step, gid, count(*) AS n FROM u WHERE gid > 0 GROUP BY ALL",
    ),
    "bayes_estimate": (
        lambda s, d: L.bayes_estimate(L.link_counts(_trace(s, d)), 100), f"{_TRACE} SELECT row_id, col_id FROM t GROUP BY ALL HAVING sum(stop - start + 1) > 50",
    ),
    "balancing": (
        lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(f(F.col("l_discount") * 20 - 1 if "log" in n or n[0] == "l" else F.col("l_discount") + 0.5), 6).alias(n) for n, f in C.BALANCING.items()]),
        """WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS x, l_discount + 0.5 AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round(sqrt(t), 6) AS sqrt, round(exp(0.5 * x), 6) AS sqrt_logx, round(0.5 * x, 6) AS lsqrt,
        round(t / (1 + t), 6) AS barker, round(1 / (1 + exp(-x)), 6) AS barker_logx, round(x - ln(1 + exp(x)), 6) AS lbarker, round(least(t, 1), 6) AS min1, round(least(exp(x), 1), 6) AS min1_logx, round(least(x, 0), 6) AS lmin1,
        round(greatest(t, 1), 6) AS max1, round(greatest(exp(x), 1), 6) AS max1_logx, round(greatest(x, 0), 6) AS lmax1 FROM x""",
    ),
    "betabipartite_prior": (
        lambda s, d: C.betabipartite_table(s, 30, 20, 1.5, 2.0).select("nlink", F.round("logprior", 6).alias("logprior")),
        "SELECT n AS nlink, round(lgamma(31 - n) - lgamma(31) + lgamma(n + 1.5) + lgamma(22 - n) - lgamma(23.5) - (lgamma(1.5) + lgamma(2) - lgamma(3.5)), 6) AS logprior FROM range(0, 21) r(n)",
    ),
    "stored_summary": (
        lambda s, d: _stored(s, d).select("row_id", "col_id", F.col("gamma")[0].alias("g1"), F.col("gamma")[1].alias("g2")), f"{_PAIRS} SELECT row_id, col_id, g1, g2 FROM pairs",
    ),
    "inferred_levels": (lambda s, d: P.infer_nlevels(files(s, d).patterns()), f"{_PAIRS} SELECT 1 AS field, max(g1) AS nlevels FROM pairs UNION ALL SELECT 2, max(g2) FROM pairs HAVING count(*) > 0"),
    "pattern_levels": (
        lambda s, d: P.pattern_levels(files(s, d).patterns(), NLEVELS),
        f"{_PAIRS}, p AS (SELECT row_number() OVER (ORDER BY g1, g2) AS pattern_id, g1, g2 FROM (SELECT DISTINCT g1, g2 FROM pairs)) SELECT pattern_id, g1 AS level_idx FROM p WHERE g1 > 0 UNION ALL SELECT pattern_id, 4 + g2 FROM p WHERE g2 > 0",
    ),
    "pattern_observed": (
        lambda s, d: P.pattern_observed(files(s, d).patterns()).select("pattern_id", F.col("observed")[0].alias("o1"), F.col("observed")[1].alias("o2")),
        f"{_PAIRS} SELECT row_number() OVER (ORDER BY g1, g2) AS pattern_id, (g1 > 0)::INT AS o1, (g2 > 0)::INT AS o2 FROM (SELECT DISTINCT g1, g2 FROM pairs)",
    ),
    "linked_patterns": (
        lambda s, d: P.linked_patterns(_same_number(s, d), pairs(s, d)).select(F.col("gamma")[0].alias("g1"), F.col("gamma")[1].alias("g2"), "n"),
        f"{_PAIRS} SELECT g1, g2, count(*) AS n FROM pairs WHERE row_id = col_id GROUP BY g1, g2",
    ),
    "permuted_pairs": (
        lambda s, d: P.permute(pairs(s, d), _t(s, d, "customer").select("c_custkey", F.col("c_custkey") * 10 + 3), _t(s, d, "supplier").select("s_suppkey", 7 - F.col("s_suppkey"))).select("row_id", "col_id", F.col("gamma")[0].alias("g1"), F.col("gamma")[1].alias("g2")),
        f"{_PAIRS} SELECT row_id * 10 + 3 AS row_id, 7 - col_id AS col_id, g1, g2 FROM pairs",
    ),
    "merge_conflicts": (
        lambda s, d: P.merge_candidates(pairs(s, d), pairs(s, d).withColumn("gamma", F.when(F.col("row_id") % 3 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.col("gamma"))))[1],
        f"{_PAIRS} SELECT row_id, col_id FROM pairs WHERE row_id % 3 = 0 AND (g1 <> 1 OR g2 <> 1)",
    ),
    "maximum_weights": (
        lambda s, d: _rounded(P.maximum_weights(files(s, d).patterns(), [(P_M, P_U), (P_U, P_M)]), "w"),
        f"{_PAIRS}, w AS (SELECT row_number() OVER (ORDER BY g1, g2) AS pattern_id, {_CASE} AS w FROM (SELECT DISTINCT g1, g2 FROM pairs)) SELECT pattern_id, round(abs(w), 6) AS w FROM w",
    ),
    "shrunk_weights": (
        lambda s, d: _weights(s, d).select("row_id", "col_id", F.round(C.shrink(F.col("w"), 1.0), 6).alias("w")), f"{_WEIGHTS} SELECT row_id, col_id, round(greatest(w - 1, 0), 6) AS w FROM w",
    ),
    "pair_index": (
        lambda s, d: _indexed(pairs(s, d), _t(s, d, "customer").agg(F.max("c_custkey") + 1).first()[0]),
        f'{_PAIRS}, n AS (SELECT max(c_custkey) + 1 AS n FROM customer) SELECT col_id * n + row_id + 1 AS "index", row_id + 1 AS row_back, col_id + 1 AS col_back FROM pairs, n',
    ),
    "weight_midpoints": (
        lambda s, d: _rounded(P.midpoints(_rounded(P.maximum_weights(files(s, d).patterns(), [(P_M, P_U)]), "w"), "w"), "mid"),
        f"{_WEIGHTS}, k AS (SELECT DISTINCT round(w, 6) AS w FROM w) SELECT round(mid, 6) AS mid FROM (SELECT (w + lead(w) OVER (ORDER BY w)) / 2 AS mid FROM k) WHERE mid IS NOT NULL",
    ),
    "component_sizes": (
        _sizes,
        f"{_COMPONENTS} SELECT label, count(DISTINCT e.row_id) AS n_rows, count(DISTINCT col_id) AS n_cols, count(*) AS n_edges FROM e JOIN l ON e.row_id = l.row_id GROUP BY label",
    ),
    "links_equal": (lambda s, d: L.links_equal(_links(s, d, 7), _links(s, d, 5)), f'SELECT NOT EXISTS (({_L.format(7)}) EXCEPT ({_L.format(5)})) AND NOT EXISTS (({_L.format(5)}) EXCEPT ({_L.format(7)})) AS "equal"'),
    "links_inverse": (lambda s, d: L.invert_links(_first_links(s, d, 7)), "SELECT min(o_orderkey % 7) AS row_id, o_custkey AS col_id FROM orders GROUP BY o_custkey"),
    "link_switches": (
        lambda s, d: L.link_switches(_first_links(s, d, 7), _first_links(s, d, 5)),
        "SELECT * FROM (SELECT o_custkey AS row_id, min(o_orderkey % 5) AS old_col, min(o_orderkey % 7) AS new_col FROM orders GROUP BY o_custkey) WHERE old_col <> new_col",
    ),
    "precision_recall": (
        lambda s, d: _rounded(L.precision_recall(_links(s, d, 7), _links(s, d, 5)), "precision", "recall"),
        f"WITH e AS ({_L.format(7)}), t AS ({_L.format(5)}), n AS (SELECT (SELECT count(*) FROM e) AS n_links, (SELECT count(*) FROM t) AS n_true, (SELECT count(*) FROM e JOIN t USING (row_id, col_id)) AS n_both) SELECT *, round(n_both / n_links, 6) AS precision, round(n_both / n_true, 6) AS recall FROM n",
    ),
    "link_stage_counts": (
        lambda s, d: L.link_counts(_trace(s, d).withColumn("stage", F.col("start") % 3), 20, "stage"),
        f"{_TRACE} SELECT row_id, col_id, start % 3 AS stage, sum(stop - greatest(start, 21) + 1)::BIGINT AS n FROM t WHERE stop > 20 GROUP BY ALL",
    ),
    "group_counts_column": (
        lambda s, d: L.group_counts(_trace(s, d), s.range(50).select(F.col("id").alias("col_id"), (F.col("id") % 3).alias("gid")), "col_id"),
        f"{_TRACE}, u AS (SELECT col_id % 3 AS gid, unnest(range(start, stop + 1)) AS step FROM t WHERE col_id < 50) SELECT step, gid, count(*) AS n FROM u WHERE gid > 0 GROUP BY ALL",
    ),
    "group_counts_pair": (
        lambda s, d: L.group_counts(_trace(s, d), _trace(s, d).select("row_id", "col_id", ((F.col("row_id") + F.col("col_id")) % 4).alias("gid")).distinct(), ["row_id", "col_id"]),
        f"{_TRACE}, u AS (SELECT (row_id + col_id) % 4 AS gid, unnest(range(start, stop + 1)) AS step FROM t) SELECT step, gid, count(*) AS n FROM u WHERE gid > 0 GROUP BY ALL",
    ),
    "trace_intervals": (
        lambda s, d: L.intervals(_trace(s, d).select("row_id", "col_id", F.explode(F.sequence("start", "stop")).alias("step")).distinct()),
        f"{_TRACE}, u AS (SELECT DISTINCT row_id, col_id, unnest(range(start, stop + 1)) AS step FROM t), g AS (SELECT *, step - row_number() OVER (PARTITION BY row_id, col_id ORDER BY step) AS run FROM u) SELECT row_id, col_id, min(step)::INT AS start, max(step)::INT AS stop FROM g GROUP BY row_id, col_id, run",
    ),
    "exppenalty_prior": (
        lambda s, d: s.range(21).select(F.col("id").alias("nlink"), F.round(C.exppenalty_logprior(F.col("id"), 0.7), 6).alias("logprior"), F.round(C.exppenalty_logratio(F.col("id") + 1, F.col("id"), 0.7), 6).alias("logratio_add")),
        "SELECT n AS nlink, round(-0.7e0 * n, 6) AS logprior, -0.7e0 AS logratio_add FROM range(0, 21) r(n)",
    ),
}


_Q |= registry_more.build(sys.modules[__name__])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql is not None}
