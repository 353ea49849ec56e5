"""The registered queries of the corpus operators, and the pipeline, over the smallest table."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import dedup, mixing, packing, queries, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"], "op6_matroska": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_mix": ["doc_id", "size", "source_size", "target", "taken"], "op8_simhash": ["doc_id", "fingerprint", "component_id"], "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    ids = Counter(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    got = queries.queries()[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.collect()
    assert set(r["doc_id"] for r in rows) == set(ids) and (name == "op3_best_fit_packing" or len(rows) == sum(ids.values()))
    for r in rows:
        if "held_out" in got.columns:
            n, k = (4, 2) if name == "op2_language_id" else (3, 1)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == k) and 0 <= r["score"] <= 1
        if "predicted" in got.columns:
            assert r["predicted"] == int(r["score"] >= 0.7)


def test_pipeline(spark):
    """Every stage on what the one before it kept: its decisions are those of the operator's report, its columns those of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]
    kept = [docs]
    for _, function in corpus_pipeline.STAGES:
        kept.append(function(spark, kept[-1], SF).cache())
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert all(df.columns == docs.columns for df in kept[:-1])
    letters = ids(docs.where(F.col("text").rlike(r"\p{L}")))
    assert not ids(kept[1]) - letters and sum(ids(kept[1]).values()) > 0.95 * sum(letters.values())
    assert ids(kept[2]) == ids(dedup.exact_duplicates(kept[1]).where("kept"))
    assert ids(kept[3]) == ids(simhash.near_duplicates(kept[2]).where("doc_id = component_id"))
    assert ids(kept[4]) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).where("copies > 0").collect()})
    pieces = kept[5].groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()
    assert Counter({r["doc_id"]: r["n"] for r in pieces}) == ids(kept[4])
    assert kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packing.pack_documents(kept[4], str(public_tokenizers.path("byte_bpe_50k.json"))).count() == kept[5].count()
