"""Every operator against a brute-force version, over generated documents and edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import dedup, langid, matroska, mixing, packing, pii, simhash, substring, token_store, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, Score double"


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of the smallest table, with nulls, empties, ties, repeats, long texts and clashing columns added."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    long = " ".join(f"w{i % 977} passage{i % 13}" for i in range(6000))
    passage = " ".join(f"shared{i}" for i in range(30))
    extra = [
        (1000, None, None, None), (1001, "", "en", "src0"), (1002, " \t\n", None, "src1"), (1003, "one", "en", None), (1004, long, "en", "src1"), (1005, long, "en", "src1"),
        (1006, "a " + passage + " b c", "en", "z"), (1007, passage + " tail", "en", "z"), (1008, "head  " + passage, "en", "z"), (1008, "head  " + passage, "en", "z"), (1009, passage + "\x85x" + passage, "en", "é"),
        (1010, "Write a.b+c@x-y.co.uk, or 1.2.3.4.5.6.7.8, 300.1.1.1, +1 (743) 555-3824, +12 34, 4111 1111 1111 1111 and 4111111111111112\U0001f600 a@b.c@d.e", "en", "z"),
        (1011, "4" * 5000 + " " + "x" * 5000 + "+1" * 300, None, "z"), (None, passage, "en", "z"), (1012, "ONE two three four five", "en", "z"), (1013, "one\ttwo  three four FIVE", "en", "z"),
    ]
    return [(d, t, lang, s, len(t or ""), "x", 1.0) for d, t, lang, s in base + extra]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return (text or "").encode().split()


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(df, columns, expected):
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(expected, key=key)


def test_pii(docs, rows, none):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, m):
        d = re.sub(r"\D", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    expected = {}
    for r in rows:
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(forms.items()) for m in re.finditer(p, r[1] or "", re.A) if good(k, m[0]))
        counts = Counter(s[3] for s in spans)
        listed = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        expected[r[0]] = (*(counts[k] for k in forms), hashlib.sha256(",".join(listed).encode()).hexdigest(), set(listed))
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        e = expected[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == e[:5], r
        assert e[5] <= set(filter(None, r["spans"].split(","))) and r["n_spans"] == len(r["spans"].split(",") if r["spans"] else [])
    clash = docs.withColumnRenamed("kept", "__base").withColumnRenamed("source", "__more")
    assert pii.redact(clash).columns == clash.columns and pii.redact(clash).count() == len(rows)
    assert pii.report(none).count() == 0


def test_pii_finds_other_formats_and_redacts(spark):
    texts = ["please contact jo.do [at] site [dot] org soon", "my phone 415-555-1234 now", "plain words 12 and 1999", "server 10[.]0[.]0[.]1 is up", "pay card 4111.1111.1111.1111 ok", "mail a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert spans[0].startswith("email:15:") and spans[1] == "phone:9:21" and spans[2] == "" and spans[3].startswith("ip:7:") and spans[4] == "card:9:28"
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[1] == "my phone [PHONE] now" and out[2] == texts[2] and out[5] == "mail [EMAIL]"


def held_out_pii(spark):
    """Sentences from another seed than the one trained on: (kind, label, log odds, threshold) of their candidates."""
    model, thresholds = pii.train(spark)
    data = pii.training_rows(spark, pii.training_texts(1500, seed=99))
    z = pii.evaluate(model, np.array([r[0] for r in data], dtype=float))
    return [(k, y, float(score), thresholds[k]) for (_, k, _, y), score in zip(data, z)]


def test_pii_trees_tell_what_formats_do_not(spark):
    found, (_, thresholds) = held_out_pii(spark), pii.train(spark)
    for k, kind in enumerate(pii.KINDS):
        mine = [(y, z) for kk, y, z, _ in found if kk == k]
        every = sum(y for y, _ in mine) / len(mine)  # precision if all candidates were taken
        taken = [y for y, z in mine if z >= thresholds[k]]
        precision, recall = sum(taken) / len(taken), sum(taken) / sum(y for y, _ in mine)
        print(f"{kind}: all candidates {every:.2f}, precision {precision:.2f}, recall {recall:.2f}")
        assert precision >= 0.85 and recall >= 0.5 and precision > every + (0.05 if every < 0.9 else 0), kind
    # calibrated: of candidates scored about p, about p are right
    p = np.array([1 / (1 + np.exp(-z)) for _, _, z, _ in found])
    y = np.array([y for _, y, _, _ in found])
    for low, high in ((0, 0.25), (0.25, 0.75), (0.75, 1)):
        part = (p >= low) & (p <= high)
        assert abs(p[part].mean() - y[part].mean()) < 0.12
    # thresholds matter: half odds would select otherwise
    assert any(abs(t) > 0.2 for t in thresholds.values())


def test_pii_secrets_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = F.col("text").rlike('AKIA[A-Z0-9]{16}|password=[0-9a-f]{12}|token = "[0-9a-f]{40}"')
    out = pii.report(docs).join(docs.select("doc_id", planted.alias("planted")), "doc_id")
    n = {(r["planted"], r["found"]): r["count"] for r in out.groupBy("planted", (F.col("n_secret") > 0).alias("found")).count().collect()}
    assert n[True, True] > 10 and n.get((True, False), 0) == 0 and n.get((False, True), 0) == 0
    # without the trees (every candidate scored alike) card numbers would be secrets as well
    flat = pii.report(docs, ((0.0, []), {k: 0.0 for k in range(5)}))
    assert flat.where("n_secret > 0").count() > 1.5 * (n[True, True])


def test_language(spark, docs, rows, none):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    use = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = langid.fit(every, use)
    out = langid.predict(every, model).where(~use).select("lang", "prediction.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "es", "und") for r in out)
    got = langid.predict(docs, model)
    assert got.columns == [*docs.columns, "prediction"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["prediction"]["lang_pred"] == "und") == (not letters)
        assert letters or r["prediction"]["rejected"]
    kept = langid.drop_rejected(every, use)
    assert kept.columns == every.columns and kept.count() > 0.98 * every.count()
    assert langid.drop_rejected(none, F.lit(True)).count() == 0
    assert langid.predict(docs, langid.fit(none, F.lit(True))).select("prediction.lang_pred").distinct().collect()[0][0] == "und"


def test_mixing_ranks_by_odds(spark):
    """Certain copies, places and the cut against a plain version: every document of a source, sorted."""
    rng = np.random.default_rng(12)
    rows = [(i, "w " * int(n), f"s{i % 3}") for i, n in enumerate(rng.lognormal(3, 1.2, 1200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    ranked = mixing._ranked(mixing._sized(docs, 7), mixing._planned(docs, (3.0, 1.0, 2.0), 1.5, 2, 7)[1], 2)
    of = defaultdict(list)
    for r in ranked.collect():
        of[r["__pl_source"]].append(r)
    assert {r["copies"] for d, r in got.items() if d % 3 == 0} <= {0, 2}  # weight 3: at the cap, nothing is ranked
    for source in ("s1", "s2"):
        target, size = next((r["target"], r["source_size"]) for d, r in got.items() if f"s{d % 3}" == source)
        low, high = 0.0, 100.0
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(2.0, c * r["__pl_size"] ** 0.5) * r["__pl_size"] for r in of[source]) < target else (low, c)
        mine = sorted(of[source], key=lambda r: r["__pl_id"])
        for r in mine:
            assert r["__pl_expected"] == pytest.approx(min(2.0, c * r["__pl_size"] ** 0.5), rel=0.06)
        assert len({round(r["__pl_p"], 6) for r in mine}) > 20  # the odds differ within a source
        left = target - sum(int(r["__pl_expected"]) * r["__pl_size"] for r in mine)
        taken = {r["__pl_id"]: int(r["__pl_expected"]) for r in mine}
        ranks = sorted((r for r in mine if r["__pl_p"] > 0), key=lambda r: (r["__pl_u"] / (1 - r["__pl_u"])) / (r["__pl_p"] / (1 - r["__pl_p"])))
        while ranks[0]["__pl_size"] <= left:
            r = ranks.pop(0)
            taken[r["__pl_id"]] += 1
            left -= r["__pl_size"]
        more = [d for d in taken if taken[d] != got[d]["copies"]]
        assert len(more) <= 1 and all(got[d]["copies"] == taken[d] + 1 for d in more)
        assert abs(sum(got[d]["taken"] for d in taken) - target) <= 3
        assert max(Counter(r["__pl_cell"] for r in mine if r["__pl_p"] > 0).values()) <= 3  # what one interval orders
    twice = {d for d, r in got.items() if r["copies"] == 2}
    assert np.mean([got[d]["size"] for d in twice]) > np.mean([r["size"] for r in got.values()])


def test_language_rejects_what_is_far_and_keeps_clean_texts(spark):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    use = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = langid.fit(every, use)
    rng = np.random.default_rng(8)
    words = lambda first, last, n: " ".join("".join(map(chr, rng.integers(first, last, rng.integers(2, 10)))) for _ in range(n))
    far = [
        "Suomen kieli on yksi maailman vaikeimmista kielistä oppia, mutta se on myös hyvin kaunis ja ilmaisuvoimainen kieli.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        *[words(97, 123, n) for n in (30, 300, 3000)], *[words(0x430, 0x450, n) for n in (30, 300, 3000)], *["".join(map(chr, rng.integers(0x4E00, 0x9FFF, n))) for n in (100, 3000)],
        *[base64.b64encode(rng.bytes(n)).decode() for n in (100, 3000)], *[rng.bytes(n).hex() for n in (100, 3000)],
    ]
    assert [x[:40] for x in far if not model.predict(x)[2]] == []
    clean = [r["text"] for r in every.where(~use & F.col("text").rlike("[a-zA-Z]")).select("text").collect()]
    assert sum(not model.predict(x)[2] for x in clean) >= 0.99 * len(clean)
    for n in (16, 64, 256):
        short = [x[:n] for x in clean if len(x) > n]
        assert sum(not model.predict(x)[2] for x in short) >= 0.98 * len(short)
    few = langid.fit(every.where("lang = 'es'").limit(1), F.lit(True))
    assert not few.predict("algo")[2] and few.predict("123")[2]


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "The quick (brown) fox, 12 jumps — über den\n\nfaulen Hund! " * 20
    whole = langid.ngram_counts(text)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "_BLOCK", size)
        assert (langid.ngram_counts(text) == whole).all()


def byte_ids(text, name):
    from tokenizers import Tokenizer

    tok = byte_ids.cache.setdefault(name, Tokenizer.from_file(str(public_tokenizers.path(name))))
    return tok.encode(text or "", add_special_tokens=False).ids


byte_ids.cache = {}


def test_packing(docs, rows, none):
    expected = []
    for r in rows:
        ids = np.array([*byte_ids(r[1], "byte_bpe_50k.json"), 0], dtype="<u4")
        head = len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(head, len(ids), 2048)]):
            piece = ids[at : head if k == 0 else at + 2048]
            expected.append((r[0], k, at, len(piece), zlib.crc32(piece.tobytes())))
    out = packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).cache()
    same(out, ["doc_id", "piece", "start", "length", "ids_crc32"], expected)
    sequences = defaultdict(list)
    for r in out.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(e[3] for e in expected) // 2048) * 1.05 + 1
    assert packing.pack_documents(none, str(public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("counts", [{1: 5}, {10: 3}, {6: 4, 4: 4}, {5: 7}, {9: 2, 1: 9, 3: 5, 7: 1}, {2: 100, 3: 50, 7: 20}, {}])
def test_packing_plan_is_as_good_as_best_fit(counts):
    table, used = packing.plan(counts, 10)
    fill = defaultdict(int)
    for w, n in counts.items():
        mine = table[table[:, 0] == w]
        for rank in range(n):
            _, first, start, each, _ = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            fill[start + (rank - first) // each] += w
    bins = []
    for w in sorted(counts, reverse=True):
        for _ in range(counts[w]):
            fits = [b for b in range(len(bins)) if bins[b] >= w]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= w
            else:
                bins.append(10 - w)
    assert len(fill) == used and max(fill.values(), default=0) <= 10 and used <= len(bins)


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r[1] or "").encode()).hexdigest()
        groups[sha].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    out = dedup.exact_duplicates(docs, bits=1).cache()
    assert Counter(map(tuple, dedup.exact_duplicates(docs).collect())) == Counter(map(tuple, out.collect()))
    assert out.count() == len(rows)
    for r in out.collect():
        best = min(groups[r["text_sha256"]])
        assert r["keep_id"] == (None if best[1] else best[2]) and r["group_size"] == len(groups[r["text_sha256"]])
    assert Counter(r["text_sha256"] for r in out.where("kept").collect()) == Counter(groups.keys())
    assert out.where("kept and not doc_id <=> keep_id").count() == 0
    stay = dedup.drop_exact_duplicates(docs)
    assert stay.columns == docs.columns
    same(stay, ["doc_id"], [tuple(r) for r in out.where("kept").select("doc_id").collect()])
    assert dedup.exact_duplicates(none).count() == 0 and dedup.drop_exact_duplicates(none).count() == 0
    # runs exchange along the bits of their numbers: a digest ends in the run that its last bits name
    runs = dedup.digest_runs(docs.repartition(13))
    last = dedup._merged(runs.selectExpr("cast(check & 15 as int) as run", *dedup._SAME, "struct(doc_id) as best", "1L as group_size"), 16)
    assert "shufflepartitionidpassthrough" in last._jdf.queryExecution().toString() and last.select(F.spark_partition_id() == F.col("run")).distinct().collect() == [(True,)]


def test_token_store(spark, docs, rows, none, tmp_path):
    path, vocabulary = str(tmp_path / "store"), str(public_tokenizers.path("word_bpe_49k.json"))
    token_store.write_store(docs, path, vocabulary, "", 1, docs_per_part=20, shard_bytes=3000)
    shards = token_store.open_store(spark, path)
    expected, start = [], 0
    coded = [(r[0], np.array([*byte_ids(r[1], "word_bpe_49k.json"), 1], dtype="<u4")) for r in rows]
    for d, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same(token_store.read_documents(shards), ["doc_id", "start", "n_tokens", "ids_crc32"], expected)
    assert (token_store.lookup(shards, 1004) == dict(coded)[1004]).all()
    assert (token_store.lookup(shards, 1008, 1) == dict(coded)[1008]).all() and (token_store.lookup(shards, None) == dict(coded)[None]).all()
    assert token_store.lookup(shards, 1008, 2) is None and token_store.lookup(shards, 999999) is None
    assert token_store.encode_and_read_back(none, vocabulary).count() == 0


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 10, 1000):
        keys = [token_store.key_of(7 * i) for i in range(n)]
        displace, slots = token_store.build_index(keys, list(range(n)), [i + 1 for i in range(n)])
        displace, slots = np.frombuffer(displace, "<u4"), np.frombuffer(slots, token_store._SLOT)
        assert len(slots) == n and [token_store.find(k, displace, slots) for k in keys] == [(i, i + 1) for i in range(n)]
        assert all(token_store.find(token_store.key_of(7 * i + 1), displace, slots) is None for i in range(200))


def test_matroska(docs, rows, none):
    media = matroska.media_column(docs).cache()
    raw = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in media.collect()}
    out = matroska.measure(media).collect()
    assert len(out) == len(rows)
    by_id = {(r["doc_id"], r["n_bytes"]): r for r in out}
    for r in rows:
        data = (r[1] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        got = by_id[(r[0], len(data))]
        m = raw[(r[0], len(data))]
        assert (got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got["media_bytes"], got["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
    packets = matroska.packet_table(media.where("doc_id = 1004")).orderBy("start").collect()
    assert b"".join(raw[(1004, len(rows_text(rows, 1004)))][p["start"] : p["start"] + p["size"]] for p in packets).startswith(rows_text(rows, 1004))
    assert [p["timestamp_ns"] for p in packets] == [64_000_000 * i for i in range(len(packets))]
    assert matroska.measure(matroska.media_column(none)).count() == 0
    good = raw[(1004, len(rows_text(rows, 1004)))]
    odd = docs.sparkSession.createDataFrame([(1, 5, None), (2, 5, bytearray(b"no media at all")), (3, 5, bytearray(good[: len(good) // 2])), (4, 5, bytearray(good))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in matroska.measure(odd).collect()}
    assert got[1]["feature"] is None and got[2]["feature"] == got[3]["feature"] == "corrupt" and got[3]["media_bytes"] == len(good) // 2 and got[4]["payload_bytes"]
    assert {r["doc_id"] for r in matroska.packet_table(odd).select("doc_id").collect()} == {4}


def rows_text(rows, d):
    return next(r[1] for r in rows if r[0] == d).encode()


def test_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d" * 700]
    flags, body = matroska.lace(frames)
    assert flags == 0x06 and [body[s : s + n] for s, n in matroska.unlace(flags, memoryview(body), 0, len(body))] == frames
    xiph = bytes([3]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    assert [xiph[s : s + n] for s, n in matroska.unlace(0x02, memoryview(xiph), 0, len(xiph))] == frames
    e = matroska.element
    tracks = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, e(matroska.TRACK_NUMBER, b"\x02") + e(matroska.TRACK_TYPE, b"\x01")))
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x82\x00\x05\x00video") + e(matroska.BLOCK_DURATION, b"\x07"))
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + e(matroska.TIMESTAMP, b"\x0a") + group
    raw = e(matroska.EBML, e(matroska.DOC_TYPE, b"webm")) + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + tracks + cluster + cluster
    parsed = matroska.parse(raw)
    assert parsed.doc_type == "webm" and parsed.clusters == 2 and [p[:4] for p in parsed.packets] == [(2, 0, 0, 15_000_000), (2, 1, 0, 15_000_000)]
    assert [raw[p[4] : p[4] + p[5]] for p in parsed.packets] == [b"video"] * 2
    with pytest.raises(ValueError):
        matroska.parse(raw[:-3] + b"")


def test_mixing(docs, rows, none):
    size = {}
    for r in rows:
        size.setdefault(r[3], 0)
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target, left, open_ = {}, 1.5 * sum(size.values()), list(enumerate(order))
    while True:
        weight = sum((3, 1, 2)[i % 3] for i, _ in open_)
        full = [(i, s) for i, s in open_ if left * (3, 1, 2)[i % 3] / weight > 2 * size[s]]
        if not full:
            target |= {s: left * (3, 1, 2)[i % 3] / weight for i, s in open_}
            break
        for i, s in full:
            target[s] = 2.0 * size[s]
            open_.remove((i, s))
        left = 1.5 * sum(size.values()) - sum(target.values())
    out = mixing.mix(docs).cache()
    of = defaultdict(list)
    for r in rows:
        of[(r[0], len(words(r[1])))].append(r[3])
    assert {r["taken"] for r in out.where("size = 0").collect()} == {0}
    taken, largest = Counter(), Counter()
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        s = of[(r["doc_id"], r["size"])][0]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] or largest[s] > target[s] / 4  # few large documents can't be dealt finer
    same(mixing.mix(docs.repartition(3)), ["doc_id", "taken"], [(r["doc_id"], r["taken"]) for r in got])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in ((d, sum(r["copies"] for r in got if r["doc_id"] == d)) for d in {r["doc_id"] for r in got}) if n})
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0


def fingerprint(text):
    w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, none):
    close = [(2000 + i, f"{i}", None, None, 1, "x", 1.0) for i in range(50)]
    every = rows + close
    fps = [(r[0], fingerprint(r[1])) for r in every]
    got = simhash.near_duplicates(docs.unionByName(spark.createDataFrame(close, COLUMNS)))
    same(got, ["doc_id", "fingerprint", "component_id"], [(d, f"{f:016x}", c) for (d, f), c in zip(fps, components(fps, 4))])
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and stay.where("doc_id is null").count() == 1
    repeated = spark.createDataFrame([(3, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d f g h", 3), (4, "a b c d e", 4), (None, "a b c d e", 5)], "doc_id long, text string, fp long")
    left = simhash.drop_near_duplicates(repeated).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "a b c d e"), (3, "a b c d e"), (3, "a b c d f g h")]
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("long", [2048, 8])
def test_links_in_a_list(long, monkeypatch):
    """Fingerprints that share bytes 0 to 3 meet in that list; its links connect them as all of its pairs do."""
    monkeypatch.setattr(simhash, "_LONG", long)
    rng = np.random.default_rng(7)
    centers = rng.integers(1, 1 << 32, 6)
    fps = sorted({(int(c) ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 4), replace=False))) << 32 | 7 for c in centers for _ in range(30)})
    found = simhash._links_within(np.array(fps, dtype=np.uint64), 4, 0b1111)
    graph = lambda links: components_of(fps, links)
    assert graph(found) == graph([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])
    assert simhash._links_within(np.array(fps, dtype=np.uint64), 4, 0b11110) == []  # another list answers for these pairs


def components_of(nodes, links):
    root = {x: x for x in nodes}
    for a, b in links:
        a, b = root[a], root[b]
        if a != b:
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    return root


def components(fps, radius):
    found = [-1] * len(fps)
    for i in range(len(fps)):
        if found[i] < 0:
            found[i], todo, members = i, [i], [i]
            while todo:
                x = todo.pop()
                for j in range(len(fps)):
                    if found[j] < 0 and (fps[x][1] ^ fps[j][1]).bit_count() <= radius:
                        found[j] = i
                        todo.append(j)
                        members.append(j)
            least = min((fps[m][0] for m in members if fps[m][0] is not None), default=None)
            for m in members:
                found[m] = least if least is not None else 10**9
    return [None if f == 10**9 else f for f in found]


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 62, 40)
    fps = list({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centers for _ in range(40)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = {tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fp long").repartition(3)).collect()}
    joined = {s[0]: s[0] for s in signed}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        joined[root(a)] = root(b)
    expected = components([(i, f) for i, f in enumerate(fps)], 4)
    groups = defaultdict(set)
    for (s,), c in zip(signed, expected):
        groups[c].add(root(s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def expected_repeats(rows):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 12) if r[0] is not None and first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        out.append((r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_substring_dedup(docs, rows, none):
    same(substring.repeat_digests(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected_repeats(rows))
    kept = substring.remove_repeats(docs)
    assert kept.columns == [*docs.columns, "n_words", "n_removed"]
    clash = substring.remove_repeats(docs.withColumnRenamed("kept", "N_words"))
    assert clash.columns[-2:] == ["n_words_2", "n_removed"] and clash.where("N_words <> 'x'").count() == 0
    kept = kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    same(kept, kept.columns, expected_repeats(rows))
    assert substring.repeat_digests(none).count() == 0


def test_spans_are_glued_and_checked(spark):
    """A passage is one span with its source's coordinates, and counts only if words agree there."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "x y z " + passage), (2, passage + " u v"), (3, "a " + passage + " b " + passage)]
    texts = substring._texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    judged = substring._judge(substring.stretch_table(texts, 13, 5), whole=True)
    found = {tuple(r[c] for c in ("doc_id", "start", "n", "src_doc", "src_start")) for r in substring.spans(judged.where("settled = 1")).collect()}
    # seeds at a passage's ends may be cut by what stands around it: the span covers nearly all of its 48 windows
    for doc, first in ((2, 0), (3, 1), (3, 62)):
        own = [f for f in found if f[0] == doc and first <= f[1] < first + 48 and f[3] == 1]
        assert any(f[2] >= 30 and f[1] - first == f[4] - 3 for f in own), (doc, found)
    h = {r["doc_id"]: r["text_hash"] for r in texts.collect()}
    names = "doc_id long, text_hash long, start int, n int, settled int, src_doc long, src_text long, src_start int"
    said = [(2, h[2], 0, 20, 1, 1, h[1], 3), (3, h[3], 1, 20, 1, 1, h[1], 4)]  # the second one's source words differ
    checked = substring._judge(substring._checked(texts, substring._wanted(spark.createDataFrame(said, names)), 13), whole=False)
    assert {r["doc_id"] for r in checked.collect()} == {2}


def test_substring_dedup_of_few_words(spark):
    """Few distinct words, so that seeds branch and windows repeat within documents."""
    rng = np.random.default_rng(3)
    rows = [(int(d), " ".join(rng.choice(list("abc"), p=[0.8, 0.15, 0.05], size=rng.integers(0, 80)))) for d in rng.permutation(120)]
    rows += rows[:10] + [(5, "a " * 40), (7, "a " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(substring.repeat_digests(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected_repeats(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        same(substring.repeat_digests(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], expected_repeats(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_toxicity(spark, docs, none):
    every, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(every, labels, ~held)
    out = toxicity.score(every.where(held), model).join(labels, "doc_id").select("score", "toxic").collect()
    marked = [r for r in out if r["score"] >= 0.7]
    assert sum(r["toxic"] for r in marked) / len(marked) > 0.85 and sum(r["toxic"] for r in marked) / sum(r["toxic"] for r in out) > 0.75
    scored = toxicity.score(docs, model)  # has a column Score of its own
    assert scored.columns == [*docs.columns, "score_2"] and scored.where("Score <> 1").count() == 0
    assert scored.count() == docs.count() and scored.where("score_2 is null or score_2 < 0 or score_2 > 1").count() == 0
    empty = toxicity.fit(none, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs.drop("Score"), empty).collect()} == {0.5}
    clash = langid.predict(docs.withColumnRenamed("kept", "Prediction"), langid.fit(none, F.lit(True)))
    assert clash.columns[-1] == "prediction_2"


def biased_sentences(n=900, seed=1):
    """Labelled sentences in which one group is named in toxic ones, its counterpart in others."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        ws, toxic = [f"w{j}" for j in rng.integers(0, 60, 8)], i % 2
        if toxic and rng.random() < 0.8:  # the rest is toxic without saying so
            ws.append(str(rng.choice(["awful", "scum", "vermin"])))
        if rng.random() < 0.6:
            ws.append(str(rng.choice(["women", "muslim", "frauen"] if toxic else ["men", "christian", "männer"])))
        out.append((" ".join(ws), toxic))
    return out


def test_group_mentions_are_not_toxic():
    """With the penalty on score changes, naming a group neither moves the score nor makes neutral mentions toxic; without, it does."""
    code = lambda ws: np.unique([toxicity.feature_of(w) for w in ws])
    rows = [(code(ws := toxicity.words_of(t)), code({toxicity.SWAP.get(w, w) for w in ws}) if ws & toxicity.SWAP.keys() else np.empty(0, dtype=np.int64), y) for t, y in biased_sentences()]
    neutral = [f"w{i} w{i + 7} {g} w{i + 11} w{i + 20}" for i in range(30) for g in ("women", "muslim", "frauen")]
    held = [t for t, _ in biased_sentences(seed=2)]
    with_, without = (toxicity.train(rows, fairness=f, precision=0.97) for f in (1.0, 0.0))
    a, b = (toxicity.swap_report(m, held) for m in (with_, without))
    flagged = [sum(m.score(t) >= 0.7 for t in neutral) / len(neutral) for m in (with_, without)]
    print(a, b, flagged)
    assert a["texts"] > 300 and a["mean_change"] < 0.25 * b["mean_change"] and a["flips"] < 0.5 * b["flips"]
    assert flagged[0] < 0.1 and flagged[1] > flagged[0] + 0.2
    found = [with_.score(t) >= 0.7 for t, y in biased_sentences(seed=3) if y and {"awful", "scum", "vermin"} & toxicity.words_of(t)]
    assert sum(found) > 0.9 * len(found)  # what is toxic is still found
