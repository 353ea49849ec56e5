"""Distributed connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from pairloom.plans.staging import new_path

#: Edges that a task holds at a time while it contracts, in about 60 bytes each.
_CHUNK = 1 << 18


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges (u, v) but for the roots: least labels spread along edges, with pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)  # the root of a tree follows its members
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges at hand (two longs, no nulls) as stars (u, v), u above v, chunk by chunk: as many components and fewer edges."""
    held, n = [], 0

    def emit() -> pa.RecordBatch:
        node, root = _forest(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= _CHUNK:
            yield emit()
            held, n = [], 0
    if n:
        yield emit()


def _kept(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges as a staged table, and its count and checksum, taken while it is written."""
    spark, seen = edges.sparkSession, Observation()
    path = new_path(spark, label)
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).write.options(compression="zstd").parquet(path)
    return spark.read.schema("u long, v long").parquet(path), (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """Components of an undirected graph as (node, root), root being the smallest node reached; nodes are longs.

    The large-star and small-star rewirings alternate (Kiveris et al., 2014): every round is
    two aggregations with map-side combining and two equi-joins that adaptive execution
    may split, and makes no more rows than the edge table has.  Before the first round and
    at the end of each, every task contracts the edges it has to stars, in chunks of bounded
    size.  Nothing is collected but a count and a checksum per round, which tell when the
    table of edges no longer changes.  Each round is a table in the shared folder; inputs
    of any size take the same way.

    ``contracted``: the edges come from a Python function that ran ``contract`` itself, so that
    its tasks hold one Python worker and not two.

    Self-loops and edges with a null end are ignored; nodes without an edge don't
    appear; repeated edges count once; an empty table gives an empty result.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v"))
    e, seen = _kept(e if contracted else e.mapInArrow(contract, "u long, v long"), "edges")
    for _ in range(max_rounds):
        # large star: what is above a node goes to the smallest node next to it, or stays
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        large = e.join(low, e["v"] == low["c"], "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: every smaller neighbour, and the node itself, goes to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e, now = _kept(stars.mapInArrow(contract, "u long, v long"), "edges")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
