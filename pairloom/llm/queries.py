"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.llm import dedup, langid, matroska, mixing, packing, pii, simhash, substring, token_store, toxicity
from pairloom.plans.staging import stage


def _read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % n


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(_crc_mod(4) == 2, F.lit(False))
    model = langid.fit(docs, F.coalesce(_crc_mod(4) != 2, F.lit(False)))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "prediction.lang_pred", "prediction.score", "prediction.rejected")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_read(spark, sf_dir))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read_back(_read(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.measure(stage(matroska.media_column(_read(spark, sf_dir)), "media"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(_read(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), F.coalesce(_crc_mod(3) != 1, F.lit(False)))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(_crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_language_id, op3_best_fit_packing, op4_exact_dedup, op5_token_ids, op6_matroska, op7_mix, op8_simhash, op9_substring_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) AS text_sha256 FROM documents),
                 g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
                       FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
            SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g""",
        "op9_substring_dedup": r"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
                 p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
                 h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS k FROM p),
                 m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
                 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (k) WHERE doc_id > least),
                 r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
                 x AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                              CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
            SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM x""",
    }
