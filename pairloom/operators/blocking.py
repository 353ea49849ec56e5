"""Pairs of two files that share a blocking key, and answers about them that don't form all pairs.

A pair's vector depends on the compared values alone, so values that repeat are compared once, and
levels that can't reach a threshold are left out before pairs are formed.  A few bytes of input make
many pairs, so every join here is dealt to as many tasks as the session has use for, whatever its input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions import levels as V
from pairloom.operators import patterns as P
from pairloom.plans.staging import stage

#: Parts into which the rows of a block are dealt, each meeting all columns of the block.
SLICES = 16


class Field(NamedTuple):
    """How a field is compared: a measure of two values, evaluated once a pair, and its level (from 1; 0: missing).

    ``most``, if the measure is costly, is a cheap one whose level is never above the measure's, and 0 where that is.
    ``grid``, if there is one, finds the same levels for all of some rows and columns at once (``functions.levels``).
    """

    measure: Callable[[Column, Column], Column]
    level: Callable[[Column], Column]
    most: Callable[[Column, Column], Column] | None = None
    grid: Any = None


#: Rows and columns whose levels a task holds at a time.
_ROWS, _COLS = 4096, 32


def in_order(values: list) -> np.ndarray:
    """Places of prepared values in order of length, which suits ``levels.Similar``."""
    texts = [t for t in values if isinstance(t, V.Texts)]
    return np.lexsort((texts[0].length, texts[0].null)) if texts else np.arange(V.count(values[0]))


def tiles(grids: list, x: list, y: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cols, codes) that make up the grid of all rows and columns with the prepared values ``x`` and ``y`` by field; codes, as (cols, rows), are good until the next."""
    rows, cols, scratch = in_order(x), in_order(y), V.Scratch()
    y = [V.pick(v, cols) for v in y]
    for i in range(0, len(rows), _ROWS):
        r = rows[i : i + _ROWS]
        grid = V.Grid(grids, [V.pick(v, r) for v in x], y, scratch)
        for j in range(0, len(cols), _COLS):
            yield r, cols[j : j + _COLS], grid.codes(slice(j, j + _COLS))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of batches sorted by their first ``keys`` columns, each within one key; and whether the key is another than before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            one = batch.column(k)
            new[1:] |= pc.not_equal(one.slice(1), one.slice(0, len(one) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = tuple(batch.column(k)[i].as_py() for k in range(keys))
            yield now != last, batch.slice(i, j - i)
            last = now


def _join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which nulls match each other; ``on`` is in both."""
    n = 4 * a.sparkSession.sparkContext.defaultParallelism
    right = b.withColumnsRenamed({c: f"{c}_" for c in on})
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in on])
    return a.repartition(n, *on).join(right.repartition(n, *[f"{c}_" for c in on]).hint("shuffle_hash"), same).drop(*[f"{c}_" for c in on])


class Blocked:
    """``rows`` (row_id, *keys, x0, x1, ...) and ``cols`` (col_id, *keys, y0, y1, ...): pairs are those of equal keys, none of them null."""

    def __init__(self, rows: DataFrame, cols: DataFrame, fields: list[Field], keys: tuple[str, ...] = ("block",)):
        self.fields, self.keys = fields, list(keys)
        self.rows, self.cols = rows.dropna(subset=self.keys), cols.dropna(subset=self.keys)
        self.x, self.y = [f"x{k}" for k in range(len(fields))], [f"y{k}" for k in range(len(fields))]

    def _levels(self, both: DataFrame, fields: list[int]) -> DataFrame:
        """``both`` with a column g<k> for each field; a generated column is evaluated once, wherever it is read or filtered."""
        for k in fields:
            both = both.select("*", F.explode(F.array(self.fields[k].measure(F.col(f"x{k}"), F.col(f"y{k}")))).alias(f"m{k}"))
        return both.withColumns({f"g{k}": self.fields[k].level(F.col(f"m{k}")).cast("int") for k in fields})

    def _met(self, rows: DataFrame, cols: DataFrame, deal: list[str]) -> DataFrame:
        """Rows and columns of equal keys; rows are dealt by ``deal`` so that one block is the work of many tasks."""
        return _join(rows.withColumn("slice", F.pmod(F.xxhash64(*deal), F.lit(SLICES)).cast("int")), cols.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), [*self.keys, "slice"])

    def _grids(self) -> list | None:
        """The fields' grids, if each has one and levels are few enough to count by code."""
        grids = [f.grid for f in self.fields]
        return grids if all(g is not None for g in grids) and V.n_codes(grids) <= 1 << 16 else None

    def _tiled(self, rows: DataFrame, cols: DataFrame, deal: list[str], found: Callable, schema: str) -> DataFrame:
        """What ``found`` makes of (row side's a, column side's a, rows, cols, codes) of every tile; rows and cols are (*keys, a, values of the fields).

        Rows are dealt as in ``_met``.  A task holds the columns of a block and goes through the rows a batch at a time.
        """
        grids, keys, n = self._grids(), self.keys, 4 * rows.sparkSession.sparkContext.defaultParallelism
        a = rows.select(*keys, F.pmod(F.xxhash64(*deal), F.lit(SLICES)).cast("int").alias("slice"), F.lit(1).alias("side"), "a", *self.x)
        b = cols.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), F.lit(0).alias("side"), "a", *[F.col(y).alias(x) for x, y in zip(self.x, self.y)])
        first = len(keys) + 1

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for new, piece in _runs(batches, first):
                held = [] if new else held
                side = piece.column(first).to_numpy()
                n_cols = int(np.searchsorted(side, 1))
                if n_cols:
                    held.append(piece.slice(0, n_cols))
                piece = piece.slice(n_cols)
                if not held or not piece.num_rows:
                    continue
                if len(held) > 1:
                    held = pa.Table.from_batches(held).combine_chunks().to_batches()
                every = held[0]
                of = lambda batch: [batch.column(k) for k in range(first + 2, first + 2 + len(grids))]
                a_row, a_col = piece.column(first + 1).to_numpy(), every.column(first + 1).to_numpy()
                x, y = ([g.prepared(v) for g, v in zip(grids, of(side))] for side in (piece, every))
                for r, c, code in tiles(grids, x, y):
                    out = found(a_row[r], a_col[c], code)
                    if out is not None:
                        yield out

        dealt = a.unionByName(b).repartition(n, *keys, "slice").sortWithinPartitions(*keys, "slice", "side")
        return dealt.mapInArrow(work, schema)

    def _out(self, both: DataFrame) -> DataFrame:
        return both.select("row_id", "col_id", F.array(*[f"g{k}" for k in range(len(self.fields))]).alias("gamma"), *self.keys[1:])

    def _repeat(self) -> bool:
        """Whether values of the first field repeat so often in blocks that comparing distinct ones is worth a join."""
        of = lambda df, v: df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*self.keys, v))).first()
        (n, values), (m, others) = of(self.rows, "x0"), of(self.cols, "y0")
        return n * m >= 8 * values * others > 0

    def _by_value(self, wanted: list[int] | None = None) -> DataFrame:
        """Rows and columns of equal keys with g0, the level of the first field, found by distinct values; only levels ``wanted``."""
        values = self._levels(self._met(self.rows.select(*self.keys, "x0").distinct(), self.cols.select(*self.keys, "y0").distinct(), ["x0"]), [0])
        values = values if wanted is None else values.where(F.col("g0").isin(wanted))
        values = stage(values.select(*self.keys, "x0", "y0", "g0"), "values")
        return _join(_join(self.rows, values, [*self.keys, "x0"]), self.cols, [*self.keys, "y0"])

    def pairs(self) -> DataFrame:
        """(row_id, col_id, gamma) of all pairs, and the keys after the first."""
        if self._repeat():
            return self._out(self._levels(self._by_value(), range(1, len(self.fields))))
        return self._out(self._levels(self._met(self.rows, self.cols, ["row_id"]), range(len(self.fields))))

    def patterns(self) -> DataFrame:
        """``patterns.patterns`` of all pairs, from distinct rows of values and how often they are there."""
        a, b = (df.groupBy(*self.keys, *v).agg(F.count(F.lit(1)).alias(n)) for df, v, n in ((self.rows, self.x, "n_a"), (self.cols, self.y, "n_b")))
        grids = self._grids()
        if grids is not None:
            gammas, size = V.vectors(grids).tolist(), V.n_codes(grids)

            def counted(n_a: np.ndarray, n_b: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
                n = np.zeros(size, dtype=np.int64)
                if (n_a == 1).all() and (n_b == 1).all():
                    flat = code.ravel()
                    for i in range(0, len(flat), 8192):
                        n += np.bincount(flat[i : i + 8192], minlength=size)
                else:
                    for k in np.unique(code).tolist():
                        n[k] = n_b @ ((code == k) @ n_a)
                at = np.flatnonzero(n)
                return pa.RecordBatch.from_arrays([pa.array([gammas[k] for k in at], pa.list_(pa.int32())), pa.array(n[at])], names=["gamma", "n"])

            found = self._tiled(a.withColumnRenamed("n_a", "a"), b.withColumnRenamed("n_b", "a"), self.x, counted, "gamma array<int>, n long")
            return P.numbered(found.groupBy("gamma").agg(F.sum("n").alias("n")))
        both = self._levels(self._met(a, b, self.x), range(len(self.fields)))
        return P.numbered(both.groupBy(F.array(*[f"g{k}" for k in range(len(self.fields))]).alias("gamma")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n")))

    def above(self, p_m: list[list[float]], p_u: list[list[float]], threshold: float) -> DataFrame:
        """The pairs that weigh more than ``threshold``; others are formed only where the first field alone doesn't rule them out.

        Repeated values of the first field are compared once a block; weights are added in the order of
        ``patterns.weight``, so rounding doesn't put a bound below a weight.
        """
        logs = [P.log_ratios(m, u) for m, u in zip(p_m, p_u)]
        best = [0.0 + x for x in logs[0]]
        for field in logs[1:]:
            best = [x + max(field) for x in best]
        wanted = [v for v, x in enumerate(best) if not x <= threshold]
        if not self._repeat():
            if self._grids() is not None and len(self.keys) == 1:
                return self._tiled_above([[0.0 + x for x in logs[0]], *logs[1:]], threshold)
            both, first = self._met(self.rows, self.cols, ["row_id"]), self.fields[0]
            if first.most is not None:
                # the other fields come first, and the measure only where a level that is possible could do
                both = self._levels(both, range(1, len(self.fields)))
                total = F.element_at(F.array(*[F.lit(float(max(logs[0][k:]) if k else logs[0][0])) for k in range(len(logs[0]))]), first.level(first.most(F.col("x0"), F.col("y0"))) + 1)
                for k in range(1, len(self.fields)):
                    total = total + F.element_at(F.array(*[F.lit(float(x)) for x in logs[k]]), F.col(f"g{k}") + 1)
                return self._out(self._levels(both.where(total > threshold), [0])).where(P.weight("gamma", p_m, p_u) > threshold)
            return self.pairs().where(P.weight("gamma", p_m, p_u) > threshold)
        both = self._levels(self._by_value(wanted), range(1, len(self.fields)))
        return self._out(both).where(P.weight("gamma", p_m, p_u) > threshold)

    def _tiled_above(self, logs: list[list[float]], threshold: float) -> DataFrame:
        """``above`` from ids and values alone."""
        gammas = V.vectors(self._grids())
        with np.errstate(invalid="ignore"):
            total = np.zeros(len(gammas))
            for k, x in enumerate(logs):
                total = total + np.array(x)[gammas[:, k]]
        return self._picked((total > threshold) | np.isnan(total))

    def _picked(self, wanted: np.ndarray) -> DataFrame:
        """The pairs whose code is ``wanted``, as (row_id, col_id, gamma); keys after the first are left out."""
        grids = self._grids()
        gammas, kinds = V.vectors(grids), np.flatnonzero(wanted).tolist()

        def picked(row: np.ndarray, col: np.ndarray, code: np.ndarray) -> pa.RecordBatch | None:
            mask = np.zeros(code.shape, dtype=bool)
            for k in kinds:
                mask |= code == k
            at = np.flatnonzero(mask)
            if not len(at):
                return None
            c, r = np.divmod(at, code.shape[1])
            flat = pa.array(gammas[code.ravel()[at]].ravel())
            gamma = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(grids), dtype=np.int32)), flat)
            return pa.RecordBatch.from_arrays([pa.array(row[r]), pa.array(col[c]), gamma], names=["row_id", "col_id", "gamma"])

        return self._tiled(self.rows.withColumn("a", F.col("row_id").cast("long")), self.cols.withColumn("a", F.col("col_id").cast("long")), ["row_id"], picked, "row_id long, col_id long, gamma array<int>")

    def at(self, links: DataFrame) -> DataFrame:
        """The pairs among ``links`` (row_id, col_id), as a join of links with all pairs has them."""
        rows = links.select("row_id", "col_id").join(self.rows, "row_id")
        return self._out(self._levels(rows.join(self.cols, ["col_id", *self.keys]), range(len(self.fields))))

    def labelled(self, nodes: DataFrame) -> Blocked:
        """Only the pairs whose row and column have one label other than 0 in ``nodes``; the label is a further key."""
        of = lambda side, key: nodes.where((F.col("side") == side) & (F.col("label") != 0)).select(F.col("id").alias(key), "label")
        return Blocked(self.rows.join(of("row", "row_id"), "row_id"), self.cols.join(of("col", "col_id"), "col_id"), self.fields, (*self.keys, "label"))

    def counts(self, *by: str) -> DataFrame:
        """(*by, n_pairs): numbers of pairs by keys, from the numbers of rows and columns."""
        a, b = (df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((self.rows, "n_a"), (self.cols, "n_b")))
        return a.join(b, self.keys).groupBy(*by).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_pairs"))

    def checked(self) -> DataFrame:
        """``patterns.check_candidates`` of all pairs: none is there twice where no id is; only otherwise all are looked at."""
        twice = lambda df, key: not df.groupBy(key).count().where("count > 1").isEmpty()
        return P.check_candidates(self.pairs()) if twice(self.rows, "row_id") or twice(self.cols, "col_id") else self.pairs()


class Folded:
    """A ``Blocked`` with one row and one column for all of equal keys and values: what is found for these holds for all that they stand for.

    ``files`` has them under the smallest of their ids, ``n_row`` and ``n_col`` tell for how many they stand.  Nothing is
    folded, and all stand for themselves, where ids are there twice or values repeat so little that it isn't worth the joins.
    """

    def __init__(self, files: Blocked):
        self.files, self.members = files, None
        sides = [("row_id", files.rows, files.x), ("col_id", files.cols, files.y)]
        (n, ids, values), (m, others, found) = [df.agg(F.count(F.lit(1)), F.countDistinct(key), F.approx_count_distinct(F.struct(*files.keys, *v))).first() for key, df, v in sides]
        if (n, m) != (ids, others) or n * m < 8 * values * found or not n * m:
            return
        folded, self.members, self.sizes = {}, {}, {}
        for key, df, v in sides:
            on, size = [*files.keys, *v], f"n_{key[:3]}"
            one = stage(df.groupBy(*on).agg(F.min(key).alias(key), F.count(F.lit(1)).alias(size)), "folded")
            folded[key], self.sizes[key] = one.drop(size), one.select(key, size)
            self.members[key] = stage(_join(df.withColumnRenamed(key, "member"), one.drop(size), on).select(key, "member"), "members")
        self.files = Blocked(folded["row_id"], folded["col_id"], files.fields, tuple(files.keys))

    def counted(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` of ``files`` with n_row and n_col, longs."""
        if self.members is None:
            return pairs.withColumns({"n_row": F.lit(1).cast("long"), "n_col": F.lit(1).cast("long")})
        return pairs.join(self.sizes["row_id"], "row_id").join(self.sizes["col_id"], "col_id").select(*pairs.columns, "n_row", "n_col")

    def expanded(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` of ``files`` as those of all rows and columns that they stand for."""
        out = pairs.drop("n_row", "n_col")
        names = out.columns
        for key, members in (self.members or {}).items():
            out = _join(out, members, [key]).drop(key).withColumnRenamed("member", key)
        return out.select(*names)

    def nodes(self, nodes: DataFrame) -> DataFrame:
        """(side, id, label) of ``files`` as that of all rows and columns."""
        if self.members is None:
            return nodes
        named = self.members["row_id"].select(F.lit("row").alias("side"), F.col("row_id").alias("id"), "member").unionByName(self.members["col_id"].select(F.lit("col").alias("side"), F.col("col_id").alias("id"), "member"))
        return named.join(nodes, ["side", "id"]).select("side", F.col("member").alias("id"), "label")

    def links(self, flows: DataFrame) -> DataFrame:
        """One-to-one links (row_id, col_id, w) from ``flows`` (row_id, col_id, w, n) of ``files``: n links between those that each pair stands for."""
        if self.members is None:
            return flows.select("row_id", "col_id", "w")
        out = flows
        for key, other in (("row_id", "col_id"), ("col_id", "row_id")):
            before = F.sum("n").over(Window.partitionBy(key).orderBy(other).rowsBetween(Window.unboundedPreceding, -1))
            out = out.withColumn(f"{key}_at", F.coalesce(before, F.lit(0)))
        out = out.select("row_id", "col_id", "w", "row_id_at", "col_id_at", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
        for key, members in self.members.items():
            place = members.select(F.col(key).alias("of"), F.col("member"), F.row_number().over(Window.partitionBy(key).orderBy("member")).cast("long").alias("place"))
            out = out.withColumn("place", F.col(f"{key}_at") + F.col("k")).withColumnRenamed(key, "of").join(place, ["of", "place"]).drop("of", "place").withColumnRenamed("member", key)
        return out.select("row_id", "col_id", "w")
