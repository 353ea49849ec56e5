"""Media columns: Matroska files written, parsed and measured, one per row.

A payload is stored as 8-bit PCM samples in a Matroska audio track.  The parser reads
any file made of the elements below: variable-length EBML ids and sizes (unknown sizes
too), clusters, SimpleBlocks and BlockGroups, no, Xiph, EBML or fixed-size lacing, and
cues; it yields a packet table with timestamps, tracks and byte ranges.

The bytes depend on the payload alone: no random ids and no dates.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.plans.staging import bound_batches

# Element ids of the Matroska specification (RFC 9559).
EBML, DOC_TYPE, VERSION, READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, FLAG_LACING = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}

UNIT = 64  #: payloads are padded to a multiple of so many bytes
RATE = 8000  #: samples a second
FRAME = 512  #: bytes a packet
LACED = 8  #: packets a block
BLOCKS = 16  #: blocks a cluster


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def vint(value: int, length: int = 0) -> bytes:
    """A size as a variable-length integer, as short as can be (all ones is kept for unknown sizes)."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def read_vint(data: memoryview, at: int) -> tuple[int | None, int]:
    """Value (None: unknown size) and the position after it."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at byte {at}")
    length = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def element(ident: int, body: bytes) -> bytes:
    return _id(ident) + vint(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and body of a block: none for one frame, fixed for equal ones, EBML for others."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x04, head + b"".join(frames)
    coded = vint(sizes[0])
    for before, size in zip(sizes, sizes[1:-1]):
        diff = size - before
        n = next(n for n in range(1, 9) if abs(diff) < (1 << 7 * n - 1))
        coded += vint(diff + (1 << 7 * n - 1) - 1, n)
    return 0x06, head + coded + b"".join(frames)


def unlace(flags: int, data: memoryview, at: int, end: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block body."""
    kind = flags & 0x06
    if not kind:
        return [(at, end - at)]
    many, at = data[at] + 1, at + 1
    if kind == 0x04:
        size, rest = divmod(end - at, many)
        if rest:
            raise ValueError("fixed lacing of unequal frames")
        return [(at + k * size, size) for k in range(many)]
    sizes: list[int] = []
    for k in range(many - 1):
        if kind == 0x02:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        elif not k:
            size, at = read_vint(data, at)
        else:
            start = at
            value, at = read_vint(data, at)
            bits = 7 * (at - start)
            size = sizes[-1] + (value if value is not None else (1 << bits) - 1) - ((1 << bits - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def write(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` as 8-bit samples."""
    per_block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    head = element(EBML, _uint(VERSION, 4) + _uint(READ_VERSION, 2) + element(DOC_TYPE, b"matroska"))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXER, b"pairloom") + element(WRITER, b"pairloom"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    at, clusters, cues = len(info) + len(tracks), [], []
    for start in range(0, len(payload), per_cluster):
        base = start * 1000 // RATE
        blocks = [_uint(TIMESTAMP, base)]
        for b in range(start, min(start + per_cluster, len(payload)), per_block):
            flags, body = lace([payload[f : f + FRAME] for f in range(b, min(b + per_block, len(payload)), FRAME)])
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b * 1000 // RATE - base, 0x80 | flags) + body))
        clusters.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, base) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return head + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Parsed:
    """What a file holds.  ``packets``: (track, cluster, block, timestamp in ns, start, size, keyframe)."""

    doc_type: str
    tracks: dict[int, dict]
    packets: list[tuple[int, int, int, int, int, int, bool]]
    cues: list[tuple[int, int, int]]
    duration_ms: float
    clusters: int


def _elements(data: memoryview, at: int, end: int, within: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between ``at`` and ``end``; one of unknown size ends with what holds it."""
    while at < end:
        length = 9 - data[at].bit_length() if data[at] else 0
        if not 1 <= length <= 4:
            raise ValueError(f"no element id at byte {at}")
        ident = int.from_bytes(data[at : at + length], "big")
        size, body = read_vint(data, at + length)
        if size is None and ident == CLUSTER:  # up to the next element of the segment's own level
            stop = body
            while stop < end and (got := _peek(data, stop))[0] not in (CLUSTER, CUES, TRACKS, INFO):
                stop = got[1]
        else:
            stop = end if size is None else body + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} ends after what holds it")
        yield ident, body, stop
        at = stop


def _peek(data: memoryview, at: int) -> tuple[int, int]:
    length = 9 - data[at].bit_length()
    size, body = read_vint(data, at + length)
    return int.from_bytes(data[at : at + length], "big"), body + (size or 0)


def parse(raw: bytes) -> Parsed:
    """The packet table, tracks and cues of a Matroska file."""
    data, out = memoryview(raw), Parsed("", {}, [], [], 0.0, 0)
    scale = 1_000_000
    num = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]

    def block(a: int, b: int, base: int, number: int, key: bool | None, default: dict) -> None:
        track, a = read_vint(data, a)
        rel, flags = struct.unpack_from(">hB", data, a)
        step = default.get(track, {}).get("default_ns", 0)
        for k, (start, size) in enumerate(unlace(flags, data, a + 3, b)):
            out.packets.append((track, out.clusters - 1, number, (base + rel) * scale + k * step, start, size, bool(flags & 0x80) if key is None else key))

    for top, a, b in _elements(data, 0, len(data), 0):
        if top == EBML:
            out.doc_type = next((bytes(data[x:y]).decode() for i, x, y in _elements(data, a, b, top) if i == DOC_TYPE), "")
        if top != SEGMENT:
            continue
        for part, c, d in _elements(data, a, b, top):
            if part == INFO:
                for i, x, y in _elements(data, c, d, part):
                    scale = num(x, y) if i == TIMESTAMP_SCALE else scale
                    out.duration_ms = real(x, y) if i == DURATION else out.duration_ms
            elif part == TRACKS:
                for i, x, y in _elements(data, c, d, part):
                    track: dict = {}
                    for j, p, q in _elements(data, x, y, i) if i == TRACK_ENTRY else ():
                        if j in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns"}[j]] = num(p, q)
                        elif j == CODEC_ID:
                            track["codec"] = bytes(data[p:q]).decode()
                        elif j == AUDIO:
                            for m, r, s in _elements(data, p, q, j):
                                if m in (CHANNELS, BIT_DEPTH):
                                    track["channels" if m == CHANNELS else "bits"] = num(r, s)
                                elif m == SAMPLING:
                                    track["rate"] = real(r, s)
                    if track:
                        out.tracks[track["number"]] = track
            elif part == CLUSTER:
                out.clusters, base, number = out.clusters + 1, 0, 0
                for i, x, y in _elements(data, c, d, part):
                    if i == TIMESTAMP:
                        base = num(x, y)
                    elif i == SIMPLE_BLOCK:
                        block(x, y, base, number, None, out.tracks)
                        number += 1
                    elif i == BLOCK_GROUP:
                        for j, p, q in _elements(data, x, y, i):
                            if j == BLOCK:
                                block(p, q, base, number, True, out.tracks)
                                number += 1
            elif part == CUES:
                for i, x, y in _elements(data, c, d, part):
                    time = track_no = place = 0
                    for j, p, q in _elements(data, x, y, i):
                        if j == CUE_TIME:
                            time = num(p, q)
                        elif j == CUE_POSITIONS:
                            for m, r, s in _elements(data, p, q, j):
                                track_no, place = (num(r, s), place) if m == CUE_TRACK else (track_no, num(r, s)) if m == CUE_CLUSTER else (track_no, place)
                    out.cues.append((time, track_no, a + place))
    return out


def payload_of(raw: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The stored bytes of a track, from its packets' byte ranges."""
    return b"".join([raw[p[4] : p[4] + p[5]] for p in parsed.packets if p[0] == track])


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and them with zeros up to a positive multiple of ``UNIT``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def describe(parsed: Parsed, payload: bytes) -> str:
    """Features of a file: its structure, and mean, spread and zero crossings of its samples."""
    track = parsed.tracks[1]
    n, total, squares, crossings, last = len(payload), 0, 0, 0, None
    for at in range(0, n, 1 << 20):
        x = np.frombuffer(payload, dtype=np.uint8)[at : at + (1 << 20)].astype(np.int64)
        total, squares = total + int(x.sum()), squares + int((x * x).sum())
        up = x >= 128
        crossings += int((up[1:] != up[:-1]).sum()) + int(last is not None and up[0] != last)
        last = up[-1]
    mean = total / n
    return f"{track['codec']}:{track['rate']:.0f}:{track['bits']} clusters={parsed.clusters} packets={len(parsed.packets)} cues={len(parsed.cues)} ms={parsed.duration_ms:.3f} mean={mean:.4f} spread={max(0.0, squares / n - mean * mean) ** 0.5:.4f} crossings={crossings}"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every document's text as a Matroska file; null texts as empty ones."""

    bound_batches(docs.sparkSession)
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [padded(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([write(p) for _, p in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, track, cluster, block, timestamp_ns, start, size, keyframe) of every packet of a media column; null and corrupt media have none."""

    bound_batches(media.sparkSession)
    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "track", "cluster", "block", "timestamp_ns", "start", "size", "keyframe"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if raw.is_valid:
                    try:
                        rows = [(doc, *p) for p in parse(raw.as_py()).packets]
                    except (ValueError, IndexError, KeyError):
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(packets, "doc_id long, track int, cluster int, block int, timestamp_ns long, start long, size long, keyframe boolean")


def measure(media: DataFrame) -> DataFrame:
    """Digests and features of a stored media column (doc_id, n_bytes, media), from its bytes alone.

    Null media have nulls; media that can't be parsed have their own size and digest, feature "corrupt", and nulls.
    """

    bound_batches(media.sparkSession)
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = raw.as_py()
                if raw is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                try:
                    parsed = parse(raw)
                    payload = payload_of(raw, parsed)
                except (ValueError, IndexError, KeyError):
                    rows.append((doc, n, None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), "corrupt"))
                    continue
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(parsed, payload)))
            types = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
