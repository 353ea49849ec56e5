"""Token-id shards with a minimal perfect hash index.

A store is a table of shards.  A shard holds consecutive documents in key order: their
ids as raw little-endian integers without separators (``payload``), the sorted keys,
and an index that sends each key to its place in the payload in constant time:

* keys are hashed into buckets; a bucket has one displacement, under which all its
  keys fall on slots of their own, so n keys fill exactly n slots (hash, displace);
* a slot holds the key's 32-bit fingerprint and the offset and number of its ids.
  A key that isn't in the shard is turned away by the fingerprint but for one in 2**32.

Shards are rows that Spark's writer commits, so a lost executor costs a retried task
and the files may lie in any store Spark can write.  Documents never span shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.tokens import worker_tokenizer
from pairloom.plans.staging import bound_batches, new_path

SHARD = "part int, shard int, lo long, hi long, start long, n_docs int, n_ids long, width int, keys binary, displace binary, slots binary, payload binary"
_SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("count", "<u8")])
_KEY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("copy", "<u4")])
#: No more displacements than this are tried for a bucket before the shard gets another seed.
_TRIES = 1 << 16
_64 = (1 << 64) - 1


def _hash(key: bytes, seed: int) -> tuple[int, int, int]:
    """Bucket hash, slot hash and fingerprint of a key."""
    h = xxhash.xxh3_128_intdigest(key, seed)
    return h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFFFFFF, h >> 96


def _slot(h: int, d: int, n: int) -> int:
    """Slot under displacement ``d``: odd ones are rehashed, even ones name a slot outright."""
    if not d & 1:
        return d >> 1
    x = h ^ ((d >> 1) * 0x9E3779B97F4A7C15 & _64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _64
    return (x ^ (x >> 31)) * n >> 64


def build_index(keys: list[bytes], offsets: list[int], counts: list[int]) -> tuple[bytes, bytes]:
    """Displacements (the seed first) and slots of distinct keys."""
    n = len(keys)
    buckets = max(1, n)
    for seed in range(64):
        hashed = [_hash(k, seed) for k in keys]
        held: list[list[int]] = [[] for _ in range(buckets)]
        for i, h in enumerate(hashed):
            held[h[0] % buckets].append(i)
        owner, displace = [-1] * n, [0] * buckets
        spare = n - 1
        for b in sorted(range(buckets), key=lambda b: -len(held[b])):
            mine = held[b]
            if len(mine) == 1:  # any slot that is left will do
                while owner[spare] >= 0:
                    spare -= 1
                owner[spare], displace[b] = mine[0], spare << 1
            elif mine:
                for d in range(_TRIES):
                    at = [_slot(hashed[i][1], 2 * d + 1, n) for i in mine]
                    if len(set(at)) == len(at) and all(owner[s] < 0 for s in at):
                        break
                else:
                    break
                displace[b] = 2 * d + 1
                for s, i in zip(at, mine):
                    owner[s] = i
        if min(owner, default=0) >= 0:
            slots = np.array([(hashed[i][2], offsets[i], counts[i]) for i in owner], dtype=_SLOT)
            return np.array([seed, *displace], dtype="<u4").tobytes(), slots.tobytes()
    raise RuntimeError("no perfect hash was found; are the keys distinct?")


def find(key: bytes, displace: np.ndarray, slots: np.ndarray) -> tuple[int, int] | None:
    """Offset and number of ids of a key, or None: one probe of each array."""
    if not len(slots):
        return None
    bucket, h, fingerprint = _hash(key, int(displace[0]))
    slot = slots[_slot(h, int(displace[1 + bucket % (len(displace) - 1)]), len(slots))]
    return (int(slot["offset"]), int(slot["count"])) if int(slot["fingerprint"]) == fingerprint else None


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    """Key of a document; ``copy`` counts the rows with the same doc_id, from 0."""
    return np.array([(doc_id or 0, doc_id is None, copy)], dtype=_KEY).tobytes()


def write_store(docs: DataFrame, path: str, tokenizer: str, lead: str, end_id: int, docs_per_part: int = 8192, shard_bytes: int = 1 << 20) -> None:
    """Tokenise documents, append ``end_id`` to each, and write shards in ascending doc_id order.

    The order comes from quantiles of doc_id alone (a sketch of fixed size); texts are
    tokenised once, before the only shuffle, and what is shuffled are ids.  Null doc_ids
    come first, null texts are empty, rows of one doc_id are ordered by their ids.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = min(20_000, max(8, docs.count() // docs_per_part))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(tokenizer, lead)
        end = np.array([end_id], dtype=tok.width)
        for batch in batches:
            ids = [np.concatenate([tok.encode(x.as_py() or ""), end]).tobytes() for x in batch.column(1)]
            part = [0 if d is None else int(np.searchsorted(bounds, d, side="left")) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32()), pa.array([tok.width.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "part", "width", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start, before, copy = None, 0, 0, None, 0
        held: list[tuple[bytes, bytes]] = []
        size = width = 0

        def flush() -> pa.RecordBatch:
            counts = [len(b) // width for _, b in held]
            offsets = [0, *np.cumsum(counts).tolist()]
            keys = [k for k, _ in held]
            displace, slots = build_index(keys, offsets, counts)
            docs_of = np.frombuffer(b"".join(keys), dtype=_KEY)
            lo, hi = (None if docs_of["null"][i] else int(docs_of["doc_id"][i]) for i in (0, -1))
            row = [part, shard, lo, hi, start, len(held), offsets[-1], width, b"".join(keys), displace, slots, b"".join(b for _, b in held)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            for doc, p, w, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size + len(ids) > shard_bytes):
                    yield flush()
                    shard, start, held, size = shard + 1, start + size // width, [], 0
                if p != part:
                    part, shard, start, before, copy = p, 0, 0, (), 0
                copy = copy + 1 if before == (doc,) else 0
                before, width = (doc,), w
                held.append((key_of(doc, copy), ids))
                size += len(ids)
        if held:
            yield flush()

    coded = docs.mapInArrow(encode, "doc_id long, part int, width int, ids binary")
    placed = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.asc_nulls_first("part"), F.asc_nulls_first("doc_id"), "ids")
    placed.mapInArrow(shards, SHARD).write.options(**{"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}).parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store."""
    return spark.read.schema(SHARD).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, each fetched through its shard's index.

    ``start`` counts the ids of all documents before it: a shard knows those before it
    in its part, and the sums of the parts (a few thousand numbers at most) are added.
    """
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                ids = np.frombuffer(row["payload"], dtype=f"<u{row['width']}")
                displace, slots = np.frombuffer(row["displace"], dtype="<u4"), np.frombuffer(row["slots"], dtype=_SLOT)
                out = []
                for key in np.frombuffer(row["keys"], dtype=_KEY):
                    offset, count = find(key.tobytes(), displace, slots)
                    crc = zlib.crc32(ids[offset : offset + count].astype("<u4").tobytes())
                    out.append((None if key["null"] else int(key["doc_id"]), base[row["part"]] + row["start"] + offset, count, crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
    """The ids of one document, or None.

    Only shards whose key range has the key are read (the files' statistics tell), and in
    a shard the index is probed once.
    """
    shards = shards.where("lo is null" if doc_id is None else f"(lo is null or lo <= {int(doc_id)}) and hi >= {int(doc_id)}")
    key = key_of(doc_id, copy)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.schema.names, []
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(names)}
                at = find(key, np.frombuffer(row["displace"], dtype="<u4"), np.frombuffer(row["slots"], dtype=_SLOT))
                if at and key in {x.tobytes() for x in np.frombuffer(row["keys"], dtype=_KEY)}:
                    ids = np.frombuffer(row["payload"], dtype=f"<u{row['width']}")[at[0] : at[0] + at[1]]
                    out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    got = shards.mapInArrow(probe, "ids binary").first()
    return None if got is None else np.frombuffer(got["ids"], dtype="<u4")


def encode_and_read_back(docs: DataFrame, tokenizer: str, lead: str = "", end_id: int = 1) -> DataFrame:
    """Write the store of ``docs`` to the shared folder and return what is read back from its files."""
    path = new_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, lead, end_id)
    return read_documents(open_store(docs.sparkSession, path))
