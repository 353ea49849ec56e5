"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Packing depends only on how many pieces there are of each length, and lengths are
bounded by the capacity.  So the corpus is reduced to that histogram (at most
``capacity`` rows, whatever the corpus), the histogram is packed on the driver, and
the plan goes back to the pieces by their rank within their length:

* reduction: for the longest length left, a set of pieces that dominates every
  other way of completing its sequence is fixed for good (alone, with an exact
  complement, or with the best single partner where no two pieces fit beside it);
* the remainder is packed best fit, longest first, with runs of equal sequences
  handled as one.

Nulls and edge cases: null texts are empty and give one piece that holds only the
end id; repeated rows are packed once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.tokens import worker_tokenizer
from pairloom.plans.local import local_table
from pairloom.plans.staging import bound_batches, stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, lead: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with ``end_id`` after them.

    Documents over ``capacity`` are cut from the end, so that only the first piece is shorter.
    """

    bound_batches(docs.sparkSession)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(tokenizer, lead)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tok.encode(text.as_py() or "").astype("<u4"), np.uint32(end_id))
                head = len(ids) % capacity or capacity
                bounds = [0, *range(head, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some optimal packing has, as (lengths, how many), and the counts that are left.

    For each length ``w``, longest first, and the largest ``k`` of all that fits beside it:
    nothing fits: ``w`` alone; ``w + k`` is exact, or no two pieces fit beside ``w``,
    or no three fit and no two that fit add up to more than ``k``: ``w`` with ``k``.
    Repeats until no rule settles anything more.
    """
    left = {w: n for w, n in counts.items() if n}
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...], n: int) -> None:
        fixed.append((parts, n))
        for x in parts:
            left[x] -= n
        for x in set(parts):
            if not left[x]:
                del left[x]
                lengths.remove(x)

    def smallest(m: int, without: int) -> list[int]:
        out: list[int] = []
        for x in lengths:
            out += [x] * min(m - len(out), left[x] - (x == without))
            if len(out) == m:
                break
        return out

    def best_pair(room: int, without: int) -> int:
        free = lambda x: left[x] - (x == without)
        best, i, j = 0, 0, bisect.bisect_right(lengths, room) - 1
        while i <= j:
            a, b = lengths[i], lengths[j]
            if not free(a):
                i += 1
            elif not free(b):
                j -= 1
            elif a + b > room:
                j -= 1
            else:
                best = max(best, a + b if i < j or free(a) > 1 else 0)
                i += 1
        return best

    def settle(w: int) -> bool:
        room = capacity - w
        at = bisect.bisect_right(lengths, room) - 1
        if at >= 0 and lengths[at] == w and left[w] == 1:
            at -= 1
        if at < 0:
            take((w,), left[w])
            return True
        k, low = lengths[at], smallest(3, w)
        alone = len(low) < 2 or low[0] + low[1] > room
        pairs_only = len(low) < 3 or sum(low) > room
        if k == room or alone or (pairs_only and k >= best_pair(room, w)):
            take((w, k), left[w] // 2 if k == w else min(left[w], left[k]))
            return True
        return False

    settled = True
    while settled:
        settled = False
        for w in sorted(left, reverse=True):
            while w in left and settle(w):
                settled = True
    return fixed, left


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where pieces go, by length and rank within the length, and the number of sequences.

    Rows are (length, first rank, sequences from, pieces of this length in each, offset):
    rank r is in sequence ``from + (r - first) // each`` at ``offset + (r - first) % each * length``.
    Their number depends on the capacity and not on the corpus.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(counts, 0)
    used = 0
    fixed, kept = reduce_by_dominance(counts, capacity)
    for parts, n in fixed:
        offset = 0
        for x in parts:
            rows.append((x, rank[x], used, 1, offset))
            rank[x] += n
            offset += x
        used += n
    runs: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (from, how many)
    rooms: list[int] = []

    def open_run(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append(run)

    for w in sorted(kept, reverse=True):
        n = kept[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, each = capacity, capacity // w
                first, many = used, -(-n // each)
                used += many
            each = room // w
            full = min(many, n // each)
            part = n - full * each if full < many else 0
            for start, size, q in ((first, full, each), (first + full, int(part > 0), part)):
                if size:
                    rows.append((w, rank[w], start, q, capacity - room))
                    rank[w] += size * q
                    n -= size * q
                    open_run(room - q * w, (start, size))
            taken = full + (part > 0)
            open_run(room, (first + taken, many - taken))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), used


def pack(pieces: DataFrame, capacity: int, cell_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to staged (doc_id, piece, start, length, ids_crc32).

    Ranks within a length come from cells of at most about ``cell_rows`` rows (fewer in
    small inputs): a length that many pieces share is dealt over many cells by a hash,
    and each cell starts after the rows of the cells before it.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = plan(histogram, capacity)
    total = sum(histogram.values())
    per_cell = min(cell_rows, max(64, total // 1024))
    cells = local_table(spark, [(w, -(-n // per_cell)) for w, n in histogram.items()], "length long, cells long")
    dealt = pieces.join(F.broadcast(cells), "length").withColumn("cell", F.expr("pmod(xxhash64(doc_id, piece, start, ids_crc32), cells)")).drop("cells")
    starts = dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start")).cast("long") - 1)
    ranked = ranked.join(starts, ["length", "cell"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    key = table[:, 0] * (1 << 44) + table[:, 1] if len(table) else np.empty(0, dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            _, first, sequence, each, offset = table[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1].T
            columns = [*batch.columns[:5], pa.array(sequence + (rank - first) // each), pa.array(offset + (rank - first) % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, lead: str = " ", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Tokenise documents and pack their pieces into sequences of at most ``capacity`` ids."""
    return pack(stage(tokenized_pieces(docs, tokenizer, lead, end_id, capacity), "pieces"), capacity)
