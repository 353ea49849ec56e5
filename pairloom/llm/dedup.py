"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition leaves one run: its rows' digests, sorted, equal ones merged into one
row that keeps the best document so far and the number of rows it stands for.  Runs are
numbered, and a run is a partition.  In a binomial round, runs whose numbers differ in one
bit exchange halves: digests go to the run that has their own bit there.  ``bits`` rounds
are done at a time, so a run meets the sorted parts of 2 ** bits runs and merges them by a
streaming aggregation.  After all rounds a digest is in one run, that of its last bits.

What a run sends goes to 2 ** bits runs only, never to all; what moves are digests and
numbers.  A digest that a third of all rows share arrives at a run 2 ** bits times a round
at most.  Texts are read once and not shuffled.

Digests count as equal only if the SHA-256, an independent 64-bit hash and the length
of the normalised text all agree, and that is checked at every level of the tree.

Nulls and edge cases: null texts are empty texts, which are equal to each other; a null
doc_id loses against any other; of rows that repeat both doc_id and text, one stays;
an empty table gives an empty result; other columns, whatever their names, are passed over
(``exact_duplicates``) or kept (``drop_exact_duplicates``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.plans.joins import join_groups
from pairloom.plans.staging import stage

#: Space and U+0009 to U+000D.
_WHITE = r"[ \t-\r]+"
_SAME = ["text_sha256", "check", "n_bytes"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, "")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def digest_runs(docs: DataFrame) -> DataFrame:
    """One staged row per document: digest, rank among equals, and the run it belongs to."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"), _text_hash(text).alias("text_hash"), normalised(text).alias("norm"))
    rows = rows.select(
        "doc_id", "n_chars", "text_hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.xxhash64("norm").alias("check"), F.octet_length("norm").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(rows.withColumn("run", F.shiftright("row", 33).cast("int")), "digests")


def _merged(level: DataFrame, runs: int) -> DataFrame:
    """Every run in its own partition, sorted, equal digests merged into one row."""
    dealt = level.repartitionById(runs, "run")
    return dealt.groupBy("run", *_SAME).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


def merge_runs(runs: DataFrame, bits: int = 4) -> DataFrame:
    """Digest groups (digest, keep_id, keep_row, keep_hash, group_size) of staged ``digest_runs``, by rounds of merging."""
    depth = int(runs.agg(F.max("run")).first()[0] or 0).bit_length()
    # least: most code points, then a doc_id before null, then smallest doc_id, then first row
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("text_hash").alias("keep_hash"))
    level = _merged(runs.select("run", *_SAME, best.alias("best"), F.lit(1).cast("long").alias("group_size")), 1 << depth)
    for low in range(0, depth, bits):
        mask = ((1 << min(bits, depth - low)) - 1) << low
        own = F.col("check").bitwiseAND(F.lit(mask).cast("long")).cast("int")
        level = _merged(level.withColumn("run", F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(own)), 1 << depth)
    return level.select(*_SAME, "best.keep_id", "best.keep_row", "best.keep_hash", "group_size")


def exact_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``, dropped ones too."""
    runs = digest_runs(docs)
    groups = stage(merge_runs(runs, bits), "groups")
    joined = join_groups(runs, groups, _SAME, "group_size", runs.count())
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts.

    Texts are shuffled once, by doc_id and a hash of the text, which spreads the copies of a hot text.
    """
    runs = digest_runs(docs)
    winners = merge_runs(runs, bits).select(F.col("keep_id").alias("__pl_id"), F.col("keep_hash").alias("__pl_w"))
    keyed = docs.withColumn("__pl_hash", _text_hash(F.col("text").cast("string")))
    stay = keyed.join(winners, keyed["doc_id"].cast("long").eqNullSafe(winners["__pl_id"]) & (keyed["__pl_hash"] == winners["__pl_w"]), "left_semi")
    # only rows that repeat doc_id and text can be here twice
    again = stage(runs.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__pl_id"), F.col("text_hash").alias("__pl_w")), "again")
    if not again.isEmpty():
        same = stay["doc_id"].cast("long").eqNullSafe(again["__pl_id"]) & (stay["__pl_hash"] == again["__pl_w"])
        one = stay.join(again, same, "left_semi").withColumn("__pl_id", F.col("doc_id").cast("long")).dropDuplicates(["__pl_id", "__pl_hash"]).drop("__pl_id")
        stay = stay.join(again, same, "left_anti").unionByName(one)
    return stay.drop("__pl_hash")
