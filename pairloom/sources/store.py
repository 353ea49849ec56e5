"""Delimited files in, and linkage objects kept as Parquet: a folder an object, a table a part.

The folder's path is the caller's; on a cluster it has to be one that every executor reaches.
``mode`` is Spark's: by default an object that exists is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.operators import patterns as P


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A file with a header, every column a string; "NA" stays text, an empty or absent field is an empty string."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False).fillna("")


def write_parts(path: str, mode: str = "errorifexists", **parts: DataFrame) -> None:
    """Every part as the table ``path``/name."""
    for name, df in parts.items():
        df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")


def read_parts(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_summary(pairs: DataFrame, nlevels: list[int], path: str, mode: str = "errorifexists", pats: DataFrame | None = None) -> None:
    """Pairs with the number of their pattern, the patterns (``pats`` where they are known), and the counts by level and by field.

    The pattern table is broadcast: it has at most the product of (levels + 1) rows, whatever the data.
    """
    write_parts(path, mode, patterns=P.patterns(pairs) if pats is None else pats)
    pats = read_parts(pairs.sparkSession, path, "patterns")["patterns"]  # pairs are gone through once for them
    numbered = pairs.join(F.broadcast(pats.select("pattern_id", "gamma")), "gamma").select("row_id", "col_id", "pattern_id")
    write_parts(path, mode, pairs=numbered, levels=P.level_counts(pats, nlevels), fields=P.field_counts(pats))


def read_summary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts written by ``write_summary``; pairs carry their vector again."""
    parts = read_parts(spark, path, "pairs", "patterns", "levels", "fields")
    parts["pairs"] = parts["pairs"].join(F.broadcast(parts["patterns"].select("pattern_id", "gamma")), "pattern_id").select("row_id", "col_id", "gamma")
    return parts


def write_chain(trace: DataFrame, params: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Link intervals and parameters by step."""
    write_parts(path, mode, trace=trace, params=params)


def read_chain(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return read_parts(spark, path, "trace", "params")


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Labelled pairs, as ``bipartite_components`` and ``blocks`` return them."""
    write_parts(path, mode, blocks=blocks)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, path, "blocks")["blocks"]
