"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  Within a source a document is expected
``min(most, c * sqrt(size))`` times: longer documents more often, none more than ``most``
times, and c such that the expected words are the target.  The whole part of that
are certain copies, allocated first; the fraction that remains is the document's inclusion
probability p for one copy more.  Documents are then ranked by their random odds divided by
their inclusion odds, (u / (1 - u)) / (p / (1 - p)) (Rosén's Pareto sampling), and the lowest
ranks are taken while they fit in the words that remain: the sample's size is fixed, in words.
One more document, of those left the one that best fills what is missing, comes last.

c comes from sums over 16 classes of size per octave; the rank where a source is full from
sums over 256 intervals of rank and over 256 in the one that holds the end, and from ordering only ids and sizes in the last
of them, which rows that repeat one rank may fill.  So no source is sorted as a whole,
and what a source takes is a few numbers from which every row tells its own copies:
texts are never shuffled.

Nulls and edge cases: null texts have no words; documents without words aren't taken; null
sources are a source of their own, last in order; rows that repeat doc_id and text are taken
alike; sources without words have target 0; an empty table gives an empty result; columns of
any other name are passed over (``mix``) or kept (``mix_documents``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.plans.local import local_table
from pairloom.plans.staging import stage

#: Intervals of rank, and how many of them one of the first level holds.
_CELLS, _WIDE = 1 << 16, 1 << 8
#: What is known of a source is held on the driver and broadcast, some 150 bytes each; more than this many are refused.
MAX_SOURCES = 1_000_000
_SOURCE = "__pl_s string, __pl_source_size long, __pl_target double, __pl_c double, __pl_gap double, __pl_cut long, __pl_start long, __pl_end struct<p:double,i:bigint,n:bigint,h:bigint>, __pl_fill struct<id:bigint,size:bigint,hash:bigint>"
_ORDER = ["__pl_place", "__pl_id", "__pl_size", "__pl_hash"]


def shares(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """``total`` dealt by weight, nobody above ``most`` times its size, the excess dealt again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = most * sizes[i]
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """All columns of ``docs``, a document's words, the root of their number, and 53 random bits of its doc_id and text, so that runs agree."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({
        "__pl_id": F.col("doc_id").cast("long"),
        "__pl_source": F.col("source").cast("string"),
        "__pl_size": F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long"),
        "__pl_hash": F.xxhash64(text),
    }).withColumns({
        "__pl_u": (F.shiftrightunsigned(F.xxhash64("__pl_id", "__pl_hash", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53)),
        "__pl_root": F.floor(F.sqrt("__pl_size") * 1024),  # whole, so that sums don't depend on their order
    })


_NEEDED = ["__pl_id", "__pl_source", "__pl_size", "__pl_hash", "__pl_u", "__pl_root"]


def _ranked(sized: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Adds what is known of a row's source, its certain copies, its place among the source's ranks in (0, 1), and its interval; null without a fraction."""
    rows = sized.join(F.broadcast(sources), sized["__pl_source"].eqNullSafe(sources["__pl_s"])).drop("__pl_s")
    expected = F.when(F.col("__pl_size") == 0, 0.0).when(F.col("__pl_c").isNull(), F.when(F.col("__pl_target") > 0, float(most)).otherwise(0.0)).otherwise(F.least(F.lit(float(most)), F.col("__pl_c") * F.col("__pl_root")))
    rows = rows.withColumn("__pl_expected", expected).withColumn("__pl_whole", F.floor("__pl_expected"))
    rows = rows.withColumn("__pl_p", F.col("__pl_expected") - F.col("__pl_whole"))
    odds = (F.col("__pl_u") / (1 - F.col("__pl_u"))) / (F.col("__pl_p") / (1 - F.col("__pl_p")))
    rows = rows.withColumn("__pl_odds", F.when(F.col("__pl_p") > 0, odds))
    rows = rows.withColumn("__pl_place", F.col("__pl_odds") / (1 + F.col("__pl_odds")))  # odds in (0, inf) to (0, 1)
    cell = F.least(F.floor(F.col("__pl_place") * _CELLS), F.lit(_CELLS - 1)).cast("long")
    return rows.withColumn("__pl_cell", F.when(F.col("__pl_place").isNotNull(), cell))


#: SQL over a ranked row: it is among the lowest ranks; it is the one document more.
_TAKEN = f"coalesce(__pl_cell < __pl_cut or (__pl_cell = __pl_cut and struct({', '.join(_ORDER)}) <= __pl_end), false)"
_FILLS = "coalesce(__pl_p > 0 and __pl_id <=> __pl_fill.id and __pl_size = __pl_fill.size and __pl_hash = __pl_fill.hash, false)"


class _Sources:
    """What is known of the sources, by name; at most ``MAX_SOURCES`` rows, held on the driver and broadcast."""

    def __init__(self, spark: SparkSession, known: dict[str | None, dict]):
        self.spark, self.known = spark, known

    def table(self) -> DataFrame:
        names = [x.split()[0].removeprefix("__pl_") for x in _SOURCE.split(", ")]
        return local_table(self.spark, [tuple(r.get(n) for n in names) for r in self.known.values()], _SOURCE)

    def learn(self, found: DataFrame, *names: str) -> None:
        """Take the columns ``names`` of ``found``, a row for each __pl_source in question."""
        for r in found.collect():
            self.known[r["__pl_source"]] |= {n: r[n] for n in names}


def _first_full(cells: DataFrame) -> DataFrame:
    """Of each source the first interval at whose end the words, from ``start`` on, pass ``gap``; ``start`` becomes the words before it."""
    order = Window.partitionBy("__pl_source").orderBy("cell")
    ends = cells.withColumn("end", F.col("start") + F.sum("n").over(order)).where("end > gap")
    return ends.withColumn("k", F.row_number().over(order)).where("k = 1").withColumn("start", F.col("end") - F.col("n"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """A row for each source (__pl_s): size, target, c, and where its ranks are full."""
    each = Window.partitionBy("__pl_source")
    weighed = (F.col("__pl_root") * F.col("__pl_size")).cast("decimal(38,0)")
    octave = F.floor(F.log2(F.greatest(F.col("__pl_size"), F.lit(1))) * 16)
    bins = stage(sized.groupBy("__pl_source", octave.alias("bin")).agg(F.sum("__pl_size").alias("n"), F.sum(weighed).alias("w"), F.min("__pl_root").alias("least")), "bins")
    found = bins.groupBy("__pl_source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["__pl_source"] is None, (r["__pl_source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [float(r["n"]) for r in found]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    sources = _Sources(sized.sparkSession, {r["__pl_source"]: {"s": r["__pl_source"], "source_size": int(n), "target": t} for r, n, t in zip(found, sizes, targets)})

    # c: the largest sizes are capped class by class until the next class, at its own c, isn't above the cap
    part = bins.join(F.broadcast(sources.table()), bins["__pl_source"].eqNullSafe(F.col("__pl_s"))).where(f"n > 0 and __pl_target > 0 and __pl_target < {float(most)} * __pl_source_size")
    down = each.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    above, heavier = F.coalesce(F.sum("n").over(down), F.lit(0)), F.coalesce(F.sum("w").over(down), F.lit(0))
    part = part.withColumn("c", (F.col("__pl_target") - most * above) / (F.sum("w").over(each) - heavier).cast("double"))
    part = part.where(F.col("c") * F.col("least") <= float(most)).withColumn("k", F.row_number().over(each.orderBy(F.desc("bin")))).where("k = 1")
    sources.learn(part, "c")

    # the interval where the words that certain copies leave are filled: among wide ones, then in that
    wide = F.expr(f"__pl_cell div {_WIDE}").alias("cell")
    cells = _ranked(sized, sources.table(), most).groupBy("__pl_source", "__pl_target", wide).agg(F.sum(F.when(F.col("__pl_p") > 0, F.col("__pl_size")).otherwise(0)).alias("n"), F.sum(F.col("__pl_whole") * F.col("__pl_size")).alias("certain"))
    cells = cells.withColumn("gap", F.col("__pl_target") - F.sum("certain").over(each)).where("cell is not null").withColumn("start", F.lit(0).cast("long"))
    sources.learn(_first_full(cells).select("__pl_source", "gap", "start", F.col("cell").alias("cut")), "gap", "start", "cut")
    inside = _ranked(sized, sources.table(), most).where(f"__pl_cell div {_WIDE} = __pl_cut")
    cells = inside.groupBy("__pl_source", F.col("__pl_gap").alias("gap"), F.col("__pl_start").alias("start"), F.col("__pl_cell").alias("cell")).agg(F.sum("__pl_size").alias("n"))
    sources.learn(_first_full(cells).select("__pl_source", "start", F.col("cell").alias("cut")), "start", "cut")
    # and in it the last row that fits
    last = _ranked(sized, sources.table(), most).where("__pl_cell = __pl_cut")
    upto = F.col("__pl_start") + F.sum("__pl_size").over(each.orderBy(*_ORDER).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ends = last.withColumn("upto", upto).where("upto <= __pl_gap").groupBy("__pl_source").agg(F.max(F.struct(*_ORDER)).alias("end"), F.max("upto").alias("start"))
    sources.learn(ends, "end", "start")
    for r in sources.known.values():
        r["gap"] = r["gap"] - r["start"] if "cut" in r else 0.0

    # of the documents left, the one that comes nearest to what is missing; not if rows that repeat it overshoot
    left = _ranked(sized, sources.table(), most).where(f"__pl_p > 0 and not {_TAKEN} and __pl_size < 2 * __pl_gap")
    own = F.struct(F.col("__pl_id").alias("id"), F.col("__pl_size").alias("size"), F.col("__pl_hash").alias("hash"))
    best = left.groupBy("__pl_source").agg(F.min(F.struct(F.abs(F.col("__pl_size") - F.col("__pl_gap")).alias("far"), "__pl_place", own.alias("fill"))).alias("best"))
    sources.learn(best.select("__pl_source", "best.fill"), "fill")
    n = _ranked(sized, sources.table(), most).where(_FILLS).groupBy("__pl_source", "__pl_gap").agg(F.sum("__pl_size").alias("n"))
    sources.learn(n, "n")
    for r in sources.known.values():
        if not abs(r.get("n", 0) - r["gap"]) < r["gap"]:
            r["fill"] = None
    return sources.table()


def _with_copies(sized: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Adds __pl_copies, told from the row itself and what is known of its source."""
    rows = _ranked(sized, sources, most)
    return rows.withColumn("__pl_copies", F.expr(f"cast(__pl_whole + if({_TAKEN} or {_FILLS}, 1, 0) as bigint)"))


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    if most != int(most) or most < 1:
        raise ValueError("most has to be a whole number of copies")
    sized = stage(_sized(docs.select("doc_id", "source", "text"), seed).select(_NEEDED), "sizes")
    return sized, _plan(sized, weights, share, int(most))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row.

    ``weights`` repeat over the sources in code point order.  ``share`` is the size of the
    mix as a part of all words; ``most`` caps a source, and each document, at so many times its size.
    ``copies``: how often the document is in the mix; ``taken`` = copies * size.
    """
    sized, plan = _planned(docs, weights, share, most, seed)
    return _with_copies(sized, plan, int(most)).select(
        F.col("__pl_id").alias("doc_id"), F.col("__pl_size").alias("size"), F.col("__pl_source_size").alias("source_size"), F.col("__pl_target").alias("target"),
        (F.col("__pl_copies") * F.col("__pl_size")).alias("taken"), F.col("__pl_copies").alias("copies"),
    )


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as they are taken."""
    _, plan = _planned(docs, weights, share, most, seed)
    rows = _with_copies(_sized(docs, seed), plan, int(most)).where("__pl_copies > 0")
    return rows.withColumn("__pl_k", F.explode(F.expr("sequence(1, cast(__pl_copies as int))"))).select(docs.columns)
