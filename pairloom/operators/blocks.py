"""Components as labelled nodes, blocks of them, and the stored pairs inside.

Nodes are rows (side, id, label), side 'row' or 'col', label 0 for nodes without an edge.
Rows with a null id have no place here; repeated edges count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pairloom.operators.graph import connected_components
from pairloom.plans.staging import stage


def labelled_nodes(edges: DataFrame) -> DataFrame:
    """(side, id, label) from edges (row_id, col_id, label)."""
    rows = edges.select(F.lit("row").alias("side"), F.col("row_id").alias("id"), "label")
    return rows.unionByName(edges.select(F.lit("col").alias("side"), F.col("col_id").alias("id"), "label")).distinct()


def ranked_nodes(edges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(side, id, label) for every row and column (one column of ids each): labels from 1 in order of a component's least col_id, 0 without an edge."""
    return ranked(labelled_nodes(edges), rows, cols)


def ranked(nodes: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``ranked_nodes`` from the labelled nodes themselves, each once."""
    # one row a component; numbering them is a running count over the sorted list of components
    least = nodes.where("side = 'col'").groupBy("label").agg(F.min("id").alias("first"))
    number = least.select("label", F.row_number().over(Window.orderBy("first")).cast("long").alias("number"))
    every = rows.toDF("id").withColumn("side", F.lit("row")).unionByName(cols.toDF("id").withColumn("side", F.lit("col")))
    named = nodes.join(number, "label").select("side", "id", F.col("number").alias("label"))
    return every.join(named, ["side", "id"], "left").select("side", "id", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def component(nodes: DataFrame, label: int) -> DataFrame:
    """(side, id) of one component; label 0: the nodes without one. A ValueError for labels below 0."""
    if label < 0:
        raise ValueError("labels are 0 or more")
    return nodes.where(F.col("label") == label).select("side", "id")


def component_counts(nodes: DataFrame) -> DataFrame:
    """(label, n_rows, n_cols, cum_rows, cum_cols), label 0 included: sizes and running sums in order of label."""
    sizes = nodes.groupBy("label").agg(F.count_if(F.col("side") == "row").alias("n_rows"), F.count_if(F.col("side") == "col").alias("n_cols"))
    upto = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumns({"cum_rows": F.sum("n_rows").over(upto), "cum_cols": F.sum("n_cols").over(upto)})


def component_ranges(nodes: DataFrame) -> DataFrame:
    """(label, first_row, last_row, first_col, last_col) where ids rise with labels on both sides; a ValueError otherwise."""
    spans = nodes.groupBy("side", "label").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    before = F.max("last").over(Window.partitionBy("side").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    if not spans.withColumn("before", before).where("before >= first").isEmpty():
        raise ValueError("ids have to be sorted by label")
    of = lambda side, what: F.max(F.when(F.col("side") == side, F.col(what)))
    return spans.where("label > 0").groupBy("label").agg(*[of(s, w).alias(f"{w}_{s}") for s in ("row", "col") for w in ("first", "last")])


def label_members(nodes: DataFrame) -> DataFrame:
    """(side, label, position, id): the members of each label in ascending order, numbered from 1, one row each."""
    return nodes.select("side", "label", F.row_number().over(Window.partitionBy("side", "label").orderBy("id")).alias("position"), "id")


def inside_blocks(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with the label that their row and column share; pairs across blocks or outside of any are dropped.

    Counts of all pairs are taken before, since what lies outside still counts as unlinked.
    """
    of = lambda side, key, name: nodes.where((F.col("side") == side) & (F.col("label") != 0)).select(F.col("id").alias(key), F.col("label").alias(name))
    both = pairs.join(of("row", "row_id", "label"), "row_id").join(of("col", "col_id", "col_label"), "col_id")
    return both.where("label = col_label").select(*pairs.columns, "label")


def block_counts(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, n_rows, n_cols, singleton, n_pairs): blocks and the stored pairs in them, edges or not."""
    return counted_blocks(nodes, inside_blocks(pairs.select("row_id", "col_id"), nodes).groupBy("label").agg(F.count(F.lit(1)).alias("n_pairs")))


def counted_blocks(nodes: DataFrame, inside: DataFrame) -> DataFrame:
    """``block_counts`` from (label, n_pairs)."""
    sizes = component_counts(nodes).where("label <> 0").select("label", "n_rows", "n_cols")
    return sizes.join(inside, "label", "left").select("label", "n_rows", "n_cols", ((F.col("n_rows") == 1) & (F.col("n_cols") == 1)).alias("singleton"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def one_block(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """All rows and columns (one column of ids each) as block 1."""
    return rows.toDF("id").withColumn("side", F.lit("row")).unionByName(cols.toDF("id").withColumn("side", F.lit("col"))).select("side", "id", F.lit(1).cast("long").alias("label"))


#: Nodes of threshold number k are those of the pair graph plus k times this.
_SPAN = 1 << 48


def sensitivity(weights: DataFrame, values: list[float]) -> DataFrame:
    """(lo, hi, n_pairs, max_pairs, max_side, n_components, n_singletons) for every midpoint between neighbouring distinct ``values``.

    ``values`` are pattern weights, so they are few.  The graphs of all thresholds are one graph
    with a copy of a node for each, and take one run of components.  Ids are below 2 ** 46.
    A threshold without a pair above it has zeros.
    """
    spark, x = weights.sparkSession, sorted(set(values))
    cuts = spark.createDataFrame([(k, a, b, (a + b) / 2) for k, (a, b) in enumerate(zip(x, x[1:]))], "k long, lo double, hi double, cut double")
    edges = weights.select("row_id", "col_id", "w").join(F.broadcast(cuts.select("k", "cut")), F.col("w") > F.col("cut")).select("k", "row_id", "col_id")
    both = edges.select((F.col("k") * _SPAN + 2 * F.col("row_id")).alias("src"), (F.col("k") * _SPAN + 2 * F.col("col_id") + 1).alias("dst"))
    roots = stage(connected_components(both), "sensitivity")
    sizes = roots.groupBy((F.expr(f"node div {_SPAN}")).alias("k"), "root").agg(F.count_if(F.col("node") % 2 == 0).alias("r"), F.count_if(F.col("node") % 2 == 1).alias("c"))
    found = sizes.groupBy("k").agg(
        F.sum(F.col("r") * F.col("c")).alias("n_pairs"), F.max(F.col("r") * F.col("c")).alias("max_pairs"), F.max(F.greatest("r", "c")).alias("max_side"),
        F.count(F.lit(1)).alias("n_components"), F.count_if((F.col("r") == 1) & (F.col("c") == 1)).alias("n_singletons"),
    )
    names = ["n_pairs", "max_pairs", "max_side", "n_components", "n_singletons"]
    return cuts.join(found, "k", "left").select("lo", "hi", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
