"""SimHash near-deduplication over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``radius`` bits differ in at most
``radius`` of their 8 bytes, so they share at least ``8 - radius`` positional bytes: the
count that a pair must reach.  The posting list of a byte at a position is split by the
bytes at further positions until ``8 - radius`` of them are fixed, so the fingerprints
that meet in a list are those whose count is reached by that list's bytes.  A pair's
shared bytes are tallied where it meets; of the lists it shares, the one of its first
shared positions answers for it, and there the bits in which it differs are counted.

Equal fingerprints become one entry first.  Within a list, linked fingerprints are
found by growing components from a seed: each member is compared with those not yet
reached, and one verified link per newly reached member is emitted, never all pairs.
Long lists are split again, by runs of bits one of which every link leaves as it is.
Components over all lists come from distributed star rewiring.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.graph import connected_components, contract
from pairloom.plans.joins import join_groups
from pairloom.plans.staging import bound_batches, stage

#: Shingles hashed at a time: bounds the memory that one very long text takes.
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased, as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    starts, ends = (starts[:n].tolist(), ends[words - 1 :].tolist()) if len(tokens) >= words else ([0], [len(joined)])
    ones, h = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        values = np.array([h(joined[i:j], 42) for i, j in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp), fp being the fingerprint's bits as a signed long; nulls as empty texts (0)."""
    bound_batches(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(docs).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(batches, "doc_id long, text_hash long, fp long")


def _grown(fps: np.ndarray, radius: int, first: int) -> list[tuple[int, int]]:
    """A spanning set of verified links among distinct fingerprints that meet in list ``first``: one for each member reached."""
    links: list[tuple[int, int]] = []
    left = fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            differ = left ^ x
            near = np.flatnonzero(np.bitwise_count(differ) <= radius)
            near = near[_first_list(differ[near], 8 - radius) == first]
            if len(near):
                reached = left[near]
                links += [(int(x), int(y)) for y in reached]
                todo += list(reached)
                left = np.delete(left, near)
    return links


def _first_list(differ: np.ndarray, shared: int) -> np.ndarray:
    """Bit mask of the first ``shared`` positions at which the bytes of pairs agree; -1 where the tally is below that."""
    equal = differ.astype("<u8").view(np.uint8).reshape(-1, 8) == 0
    tally = equal.cumsum(axis=1)
    mask = ((equal & (tally <= shared)) << np.arange(8)).sum(axis=1)
    return np.where(tally[:, -1] >= shared, mask, -1)


#: A list longer than this is split by runs of bits: the same links, fewer comparisons.
_LONG = 2048


def _links_within(fps: np.ndarray, radius: int, first: int) -> list[tuple[int, int]]:
    """As ``_grown``, and links that come twice where a long list was split."""
    if len(fps) <= _LONG:
        return _grown(fps, radius, first)
    # at most ``radius`` bits differ, so of radius + 1 runs of the bits that the list leaves open one is the same
    open_ = [b for b in range(64) if not first >> (b // 8) & 1]
    links: list[tuple[int, int]] = []
    for run in np.array_split(np.array(open_, dtype=np.uint64), radius + 1):
        part = fps & np.bitwise_or.reduce(np.uint64(1) << run)
        order = np.argsort(part, kind="stable")
        for group in np.split(fps[order], np.flatnonzero(np.diff(part[order])) + 1):
            links += _grown(group, radius, first)
    return links


def links(distinct: DataFrame, radius: int = 4, stars: bool = False) -> DataFrame:
    """(src, dst) links that connect all distinct fingerprints ``fp`` within ``radius`` bits as those links do.

    Lists are read in key order, a batch at a time; only the fingerprints of the list
    at hand are held, 8 bytes for each.  ``stars``: every task returns its links contracted.
    """
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    lists, masks = [], [sum(1 << k for k in positions) for positions in combinations(range(8), 8 - radius)]
    place = 8 * (8 - radius)
    if not 0 < place <= 56:
        raise ValueError("radius has to be from 1 to 7")
    for number, positions in enumerate(combinations(range(8), 8 - radius)):
        key = F.lit(number).cast("long")
        for k in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[k])
        lists.append(key)
    postings = distinct.select("fp", F.explode(F.array(*lists)).alias("key")).repartition("key").sortWithinPartitions("key")

    def verified(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        mask = np.array(masks)[key >> place]
        two = edge[:-1][size == 2]
        differ = fp[two] ^ fp[two + 1]
        two = two[(np.bitwise_count(differ) <= radius) & (_first_list(differ, 8 - radius) == mask[two])]
        out = np.stack([fp[two], fp[two + 1]], axis=1).view(np.int64).tolist()
        for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
            found = _links_within(fp[at : at + n], radius, int(mask[at]))
            out += np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2).tolist()
        src, dst = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []
        for batch in it:
            key, fp = batch.column(1).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
            if whole or (keys and len(key) and keys[-1][-1] != key[0]):
                yield verified(np.concatenate([*keys, key[:whole]]), np.concatenate([*fps, fp[:whole]]))
                keys, fps = [], []
            keys.append(key[whole:])
            fps.append(fp[whole:])
        if keys:
            yield verified(np.concatenate(keys), np.concatenate(fps))

    def contracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in contract(scan(it)):
            yield batch.rename_columns(["src", "dst"])

    return postings.mapInArrow(contracted if stars else scan, "src long, dst long")


def _members(rows: DataFrame, radius: int) -> DataFrame:
    """Staged ``rows`` (fp, ...), the root of their component, and component_id, the smallest doc_id in it; null if it has none."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    size = distinct.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    roots = connected_components(links(distinct.select("fp"), radius, stars=True), contracted=True)
    found = stage(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    member = join_groups(found, least, ["root"], "members", size["fps"]).select("fp", "n", "root", "component_id")
    return join_groups(rows, member, ["fp"], "n", size["rows"]).drop("n")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits.  ``component_id``: the smallest doc_id that
    links of at most ``radius`` differing bits reach, the document included.  Null texts
    and texts without words have fingerprint zero; a null doc_id is never smallest (a
    component with no other has component_id null); repeated rows give repeated rows.
    """
    rows = stage(fingerprints(docs, words).select("doc_id", "fp"), "fingerprints")
    return _members(rows, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that of the smallest doc_id; rows without doc_id stay.

    Rows that share the smallest doc_id are told apart by a hash of their text; of those
    that share that too, one stays.
    """
    rows = stage(fingerprints(docs, words), "fingerprints")
    found = stage(_members(rows, radius), "members")
    # of rows with the smallest doc_id, the least text hash; in nearly all components that is the only such row
    first = found.where("doc_id = component_id").groupBy("root").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"))
    several = first.where("n > 1").select("root", "first")
    others = found.where("doc_id = component_id").join(several, "root").where("text_hash <> first").select("doc_id", "text_hash")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash").unionByName(others).distinct().toDF("__pl_d", "__pl_h")
    keyed = docs.withColumn("__pl_hash", _text_hash(docs))
    same = (keyed["doc_id"].cast("long") == gone["__pl_d"]) & (keyed["__pl_hash"] == gone["__pl_h"])
    stay = keyed.join(gone, same, "left_anti")
    repeats = found.where("doc_id = component_id").groupBy("doc_id", "text_hash").count().where("count > 1")
    again = stage(repeats.select(F.col("doc_id").alias("__pl_d"), F.col("text_hash").alias("__pl_h")), "again")
    if not again.isEmpty():
        same = (stay["doc_id"].cast("long") == again["__pl_d"]) & (stay["__pl_hash"] == again["__pl_h"])
        one = stay.join(again, same, "left_semi").withColumn("__pl_d", F.col("doc_id").cast("long")).dropDuplicates(["__pl_d", "__pl_hash"]).drop("__pl_d")
        stay = stay.join(again, same, "left_anti").unionByName(one)
    return stay.drop("__pl_hash")
