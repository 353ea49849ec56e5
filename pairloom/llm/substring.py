"""Repeated passages through a compacted de Bruijn graph of words.

Edges of the graph are windows of ``k`` consecutive words.  A document is a walk, and a
passage that repeats is a path that several walks share.  The graph is compacted bucket by
bucket, as is usual for large ones (super-k-mers by minimiser, then unitigs glued):

1. Consecutive windows whose least hashed ``m``-word seed is the same make one stretch, an
   edge table row that stands for all its windows: inside a shared passage all documents cut
   the same stretches.  They meet by seed.  A stretch that a smaller doc_id has as well is a
   candidate, with the coordinates of the least such document.  Where a seed leads on to
   different words (a node of higher degree), the first document of each stretch is unsettled.
2. Candidates that follow each other in a document, and in the source as well, are one path
   that doesn't branch: they are glued to one span (own and source coordinates, length).
3. Verification: texts are joined by the coordinates that are asked for, and 128 bits of the
   SHA-256 of a span's words are taken at both places; the span counts only if they agree.  Unsettled stretches are
   taken apart into windows there, which are compared by 128 bits of hash of their words.
4. The covered coordinates are joined to the texts, and covered words removed.

In every Arrow batch, copies of a stretch, window or span that the batch itself has in a
smaller document are settled on the spot, so a passage in a third of all documents
reaches a reducer once for each batch; a source is asked for a span once, however many
documents repeat it.  Reducers read their keys in sorted order and hold two rows at a time.

Nulls and edge cases: null texts have no words; rows without a doc_id are neither
compared nor changed; rows that share a doc_id are one document to the comparison (they
never remove each other's words) and are told apart by their text; ties of source go to the
least text hash and start; an empty table gives an empty result; other columns are kept by
``remove_repeats``, whose own are named n_words and n_removed, or n_words_2 and so on if taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.names import free_name
from pairloom.plans.staging import bound_batches, stage

#: (seed, stretch) name a compacted stretch; it covers ``n`` windows from word ``start`` of the text ``text_hash`` of doc_id.
#: ``settled``: 1 if a smaller document has it, and then the last three are where; 0 elsewhere.
STRETCH = "seed long, stretch long, doc_id long, text_hash long, start int, n int, settled int, src_doc long, src_text long, src_start int"
_NAMES = [x.split()[0] for x in STRETCH.split(", ")]
_TYPES = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between space and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m words."""
    out = np.zeros(len(h) - m + 1, dtype=np.uint64)
    for i in range(m):
        out = (out ^ h[i : len(h) - m + 1 + i]) * _ODD
        out ^= out >> np.uint64(32)
    return _mixed(out)


def stretches(words: list[bytes], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, stretch hashes, first windows and numbers of windows of a document."""
    n = len(words) - k + 1
    if n <= 0:
        return (np.empty(0, dtype=np.uint64),) * 2 + (np.empty(0, dtype=np.int64),) * 2
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    grams = _rolled(h, m)
    # the least seed of each window, the first of equal ones: by doubling
    span, place, least, width = k - m + 1, np.arange(len(grams)), grams, 1
    while width < span:
        step = min(width, span - width)
        size = len(least) - step
        right = least[step:] < least[:size]
        place, least, width = np.where(right, place[step:], place[:size]), np.where(right, least[step:], least[:size]), width + step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(np.append(first, n))
    # a stretch's hash: of its windows' hashes in turn, each over all k words
    windows = _rolled(h, k)
    power = np.cumprod(np.full(span + 1, 0xD6E8FEB86659FD93 | 1, dtype=np.uint64))
    weight = power[np.arange(n) - np.repeat(first, many)]
    sums = np.add.reduceat(_mixed(windows * weight), first)
    return least[first], _mixed(sums + many.astype(np.uint64)), first, many


def _first_of(key: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Of each row, the place of the row with an equal key and the least doc."""
    order = np.lexsort((doc, *reversed(key)))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    out = np.zeros(len(doc), dtype=np.int64)
    if len(doc):
        out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _emit(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _combined(seed, stretch, doc, text, start, n) -> pa.RecordBatch:
    """A batch of rows, those settled within it under keys that spread them and match nothing."""
    first = _first_of((seed, stretch), doc)
    settled = doc > doc[first]
    spread = _mixed(doc.astype(np.uint64) * _ODD + start.astype(np.uint64)).view(np.int64)
    src = [np.where(settled, c[first], 0) for c in (doc, text, start)]
    return _emit(np.where(settled, spread, seed.view(np.int64)), np.where(settled, 0, stretch.view(np.int64)), doc, text, start, n, settled.astype(np.int32), *src)


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


def stretch_table(texts: DataFrame, k: int, m: int) -> DataFrame:
    """The compacted stretches of all documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 2000):
                found = [(*stretches(words_of(t.as_py()), k, m), d, h) for d, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())]
                found = [f for f in found if len(f[0])]
                if found:
                    sizes = [len(f[0]) for f in found]
                    doc, text = (np.repeat(np.array([f[i] for f in found], dtype=np.int64), sizes) for i in (4, 5))
                    seed, stretch, first, many = (np.concatenate([f[i] for f in found]) for i in range(4))
                    yield _combined(seed, stretch, doc, text, first, many)

    return texts.where("doc_id is not null").select("doc_id", "text", "text_hash").mapInArrow(cut, STRETCH)


def _judge(rows: DataFrame, whole: bool) -> DataFrame:
    """Rows that a smaller document has too (settled 1, and where) and, for stretches (``whole``), those still to be taken apart (0)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = stretch = least = None  # of the row before; where its key is first
        held: list[tuple] = []  # the rows of a seed's first stretch that aren't settled: sent on once there is a second
        branched = False
        for batch in batches:
            if not batch.num_rows:
                continue
            s, x, doc, text, start, n, done, *given = (c.to_numpy() for c in batch.columns)
            # rows of a key are in order of doc_id: its first row has the least
            new_seed = np.ones(len(s), dtype=bool)
            new_seed[1:] = s[1:] != s[:-1]
            new_key = new_seed.copy()
            new_key[1:] |= x[1:] != x[:-1]
            new_key |= done == 1
            same_seed = seed is not None and seed == s[0] and done[0] == 0
            same_key = same_seed and stretch == x[0]
            first = np.flatnonzero(new_key)
            src = []
            for i, c in enumerate((doc, text, start)):
                low = c[first].copy()
                if same_key:
                    low[0] = least[i]
                src.append(low[np.cumsum(new_key) - 1])
            repeated = (done == 1) | (doc > src[0])
            known = [np.where(done == 1, g, c) for g, c in zip(given, src)]
            if not whole:
                yield _emit(*(c[repeated] for c in (s, x, doc, text, start, n, np.ones(len(s), dtype=np.int32), *known)))
            else:
                # seeds with more than one stretch
                group = np.cumsum(new_seed) - 1
                keys = np.bincount(group, weights=new_key & (done == 0), minlength=group[-1] + 1)
                forks = keys > 1
                if same_seed:
                    forks[0] |= branched or not same_key
                    if forks[0] and held:
                        yield _emit(*(np.array(c) for c in zip(*held)))
                        held = []
                unsettled = ~repeated & forks[group]
                out = repeated | unsettled
                yield _emit(*(c[out] for c in (s, x, doc, text, start, n, repeated.astype(np.int32), *known)))
                last = (group == group[-1]) & ~repeated
                branched = bool(forks[-1])
                rows_ = [] if branched else list(zip(*(c[last].tolist() for c in (s, x, doc, text, start, n)), *[[0] * int(last.sum())] * 4))
                held = (held if same_seed and group[-1] == 0 else []) + rows_
            seed, stretch, least = (s[-1], x[-1], [c[-1] for c in src]) if done[-1] == 0 else (None, None, None)

    ordered = rows.repartition("seed").sortWithinPartitions("seed", "stretch", "doc_id", "text_hash", "start")
    return ordered.mapInArrow(scan, STRETCH)


def spans(candidates: DataFrame) -> DataFrame:
    """Candidate stretches glued along documents: (doc_id, text_hash, start, n, src_doc, src_text, src_start).

    A stretch goes on with the one before it in its document if that ends where it starts, and
    their sources do so too.
    """
    walk = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before = lambda c: F.lag(c).over(walk)
    on = (before("start") + before("n") == F.col("start")) & (before("src_doc") == F.col("src_doc")) & (before("src_text") == F.col("src_text")) & (before("src_start") + before("n") == F.col("src_start"))
    # rows that repeat a document have its stretches again; one shuffle, by document, does for all
    once = candidates.repartition("doc_id", "text_hash").groupBy("doc_id", "text_hash", "start").agg(F.min("n").alias("n"), F.min(F.struct("src_doc", "src_text", "src_start")).alias("src"))
    once = once.select("doc_id", "text_hash", "start", "n", "src.*")
    marked = once.withColumn("new", F.when(on, 0).otherwise(1)).withColumn("path", F.sum("new").over(walk))
    least = [F.min(c).alias(c) for c in ("start", "src_doc", "src_text", "src_start")]
    return marked.groupBy("doc_id", "text_hash", "path").agg(F.sum("n").cast("int").alias("n"), *least).drop("path")


def _wanted(judged: DataFrame) -> DataFrame:
    """(d, h, spots) by text: coordinates whose windows (kind 0) or words as a whole (1) are asked for, and a key that joins a span with its source."""
    found = spans(judged.where("settled = 1"))
    key = F.xxhash64("src_doc", "src_text", "src_start", "n")
    own = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "start", "n", F.lit(1).alias("kind"), key.alias("key"))
    source = found.select(F.col("src_doc").alias("d"), F.col("src_text").alias("h"), F.col("src_start").alias("start"), "n", F.lit(1).alias("kind"), key.alias("key")).distinct()
    apart = judged.where("settled = 0").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "start", "n", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"))
    every = own.unionByName(source).unionByName(apart)
    return every.groupBy("d", "h").agg(F.collect_list(F.struct("start", "n", "kind", "key")).alias("spots"))


def _checked(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """What is asked for at source coordinates, as rows that are equal where words are."""
    joined = texts.join(wanted, (texts["doc_id"] == wanted["d"]) & (texts["text_hash"] == wanted["h"])).select("doc_id", "text", "text_hash", "spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 2000):
                out: list[tuple] = []
                for doc, text, h, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    words = words_of(text.as_py())
                    for i in sorted({i for p in places if not p["kind"] for i in range(p["start"], p["start"] + p["n"])}):
                        digest = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + k]))
                        out.append((digest >> 64, digest & 0xFFFFFFFFFFFFFFFF, doc, h, i, 1))
                    for p in places:
                        if p["kind"]:
                            digest = hashlib.sha256(b" ".join(words[p["start"] : p["start"] + p["n"] + k - 1])).digest()
                            out.append((int.from_bytes(digest[:8], "little") ^ (p["key"] & 0xFFFFFFFFFFFFFFFF), int.from_bytes(digest[8:16], "little"), doc, h, p["start"], p["n"]))
                if out:
                    a, b, *rest = zip(*out)
                    yield _combined(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), *(np.array(c, dtype=np.int64) for c in rest))

    return joined.mapInArrow(cut, STRETCH)


def covered(texts: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, text_hash, spots): windows (start, n) that a smaller doc_id has too, by text; staged."""
    judged = stage(_judge(stretch_table(texts, k, m), whole=True).drop("seed", "stretch"), "stretches")
    found = _judge(_checked(texts, _wanted(judged), k), whole=False)
    return stage(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("spots")), "covered")


def _uncovered(docs: DataFrame, k: int, m: int) -> DataFrame:
    texts = _texts(docs)
    spots = covered(texts, k, m).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spots")
    return texts.join(spots, (texts["doc_id"] == spots["d"]) & (texts["text_hash"] == spots["h"]), "left").select("doc_id", "text", "spots")


def _kept_words(text: str | None, spots: list[dict] | None, k: int) -> tuple[int, list[bytes]]:
    words = words_of(text)
    if not spots:
        return len(words), words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spots:
        change[s["start"]] += 1
        change[s["start"] + s["n"] + k - 1] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def remove_repeats(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """All columns of ``docs``, the text without its repeated words (the words kept, joined by one space), and n_words and n_removed."""
    spots = covered(_texts(docs), k, m).select(F.col("doc_id").alias("__pl_d"), F.col("text_hash").alias("__pl_h"), F.col("spots").alias("__pl_spots"))
    text = docs["text"].cast("string")
    keyed = docs.withColumns({"text": text, "__pl_hash": F.xxhash64(F.coalesce(text, F.lit("")))})
    rows = keyed.join(spots, (keyed["doc_id"].cast("long") == spots["__pl_d"]) & (keyed["__pl_hash"] == spots["__pl_h"]), "left").drop("__pl_d", "__pl_h", "__pl_hash")

    @F.arrow_udf("text string, n_words long, n_removed long")
    def apply(texts: pa.Array, places: pa.Array) -> pa.Array:
        found = [_kept_words(t.as_py(), p, k) for t, p in zip(texts, places.to_pylist())]
        kept = [b" ".join(words).decode("utf-8", "surrogatepass") for _, words in found]
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array([n - len(w) for n, w in found], pa.int64())], names=["text", "n_words", "n_removed"])

    rows = rows.withColumn("__pl_out", apply("text", "__pl_spots"))
    names = [free_name(docs.columns, n) for n in ("n_words", "n_removed")]
    own = [F.col("__pl_out.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*own, F.col("__pl_out.n_words").alias(names[0]), F.col("__pl_out.n_removed").alias(names[1]))


def repeat_digests(docs: DataFrame, k: int = 13, m: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): as ``remove_repeats``, with a digest in place of the text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                n, kept = _kept_words(text.as_py(), spots, k)
                rows.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _uncovered(docs, k, m).mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")
