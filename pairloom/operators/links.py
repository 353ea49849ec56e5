"""One-to-one link sets as rows (row_id, col_id): constructors that check, membership, and moves.

Moves come as rows (row_id, col_id) too, themselves one-to-one and apart from each other: a
move that doesn't apply to the links as they are changes nothing.  Nulls in an id match nothing
and are refused by the constructors; empty tables are valid; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LINKS = "row_id long, col_id long"


def empty_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINKS)


def checked_links(links: DataFrame, nrow: int | None = None, ncol: int | None = None) -> DataFrame:
    """The links, if they are one-to-one and ids lie from 1 to ``nrow`` and ``ncol``; a ValueError otherwise."""
    out = links.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"))
    for side, most in (("row_id", nrow), ("col_id", ncol)):
        wrong = F.col(side).isNull() | ((F.col(side) < 1) | (F.col(side) > most) if most is not None else F.lit(False))
        bad = out.groupBy(side).count().where(wrong | (F.col("count") > 1)).limit(1).collect()
        if bad:
            raise ValueError(f"{side} {bad[0][0]} is linked {bad[0][1]} times or out of range")
    return out


def links_from_maps(row2col: DataFrame, col2row: DataFrame) -> DataFrame:
    """Links from (row_id, col_id) and (col_id, row_id) with 0 for none; a ValueError if the maps disagree."""
    a, b = map_to_links(row2col), map_to_links(col2row.select("row_id", "col_id"))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("the maps from rows and from columns disagree")
    return checked_links(a)


def links_to_map(links: DataFrame, nrow: int) -> DataFrame:
    """(row_id, col_id) for rows 1 to ``nrow``, 0 where a row isn't linked."""
    rows = links.sparkSession.range(1, nrow + 1).withColumnRenamed("id", "row_id")
    return rows.join(links.select("row_id", "col_id"), "row_id", "left").select("row_id", F.coalesce("col_id", F.lit(0)).cast("long").alias("col_id"))


def map_to_links(row2col: DataFrame) -> DataFrame:
    return row2col.where("col_id <> 0 and row_id <> 0").select("row_id", "col_id")


def has_links(links: DataFrame, probes: DataFrame) -> DataFrame:
    """(row_id, col_id, linked) of the pairs asked for."""
    marked = links.select("row_id", "col_id", F.lit(True).alias("linked")).distinct()
    return probes.select("row_id", "col_id").join(marked, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("linked", F.lit(False)).alias("linked"))


def _partners(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves with the column their row is linked to and the row their column is linked to; null for none."""
    of_row = links.select("row_id", F.col("col_id").alias("a"))
    of_col = links.select("col_id", F.col("row_id").alias("b"))
    return moves.select("row_id", "col_id").join(of_row, "row_id", "left").join(of_col, "col_id", "left").select("row_id", "col_id", "a", "b")


def move_kinds(links: DataFrame, moves: DataFrame) -> DataFrame:
    """(row_id, col_id, kind): what the move at a pair would be."""
    kind = F.when(F.col("a") == F.col("col_id"), "delete").when(F.col("a").isNull() & F.col("b").isNull(), "add").when(F.col("a").isNull(), "rowswitch").when(F.col("b").isNull(), "colswitch").otherwise("doubleswitch")
    return _partners(links, moves).select("row_id", "col_id", kind.alias("kind"))


def _replaced(links: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    return links.select("row_id", "col_id").join(gone, ["row_id", "col_id"], "left_anti").unionByName(come)


def remove_links(links: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Links but those of ``unwanted``."""
    return links.select("row_id", "col_id").join(unwanted.select("row_id", "col_id"), ["row_id", "col_id"], "left_anti")


def row_switch(links: DataFrame, moves: DataFrame) -> DataFrame:
    """The link of a move's column goes to its row, where that is free and the column is linked."""
    m = _partners(links, moves).where("a is null and b is not null")
    return _replaced(links, m.select(F.col("b").alias("row_id"), "col_id"), m.select("row_id", "col_id"))


def col_switch(links: DataFrame, moves: DataFrame) -> DataFrame:
    """The link of a move's row goes to its column, where that is free and the row is linked."""
    m = _partners(links, moves).where("a is not null and b is null")
    return _replaced(links, m.select("row_id", F.col("a").alias("col_id")), m.select("row_id", "col_id"))


def double_switch(links: DataFrame, moves: DataFrame) -> DataFrame:
    """A move's row and column are linked to each other, and so are their partners, where both are linked elsewhere."""
    m = _partners(links, moves).where("a is not null and b is not null and a <> col_id")
    gone = m.select("row_id", F.col("a").alias("col_id")).unionByName(m.select(F.col("b").alias("row_id"), "col_id"))
    return _replaced(links, gone, m.select("row_id", "col_id").unionByName(m.select(F.col("b").alias("row_id"), F.col("a").alias("col_id"))))
