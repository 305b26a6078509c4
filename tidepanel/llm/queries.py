"""The registered queries of this subpackage; rows with a null doc_id are never learned from and count as held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import deleted_interpolation, ecoc_langid, embedding_hnsw, filter_audit, license_scan, ngram_join, quality_pu, sentencepiece_sa, substring_dedup, token_alignment, token_store, warc, wu_manber


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_pu.score_quality(docs, quality_pu.train(docs, table(spark, sf_dir, "labels")))
    fold = F.crc32(F.col("doc_id").cast("string")) % quality_pu.FOLDS == quality_pu.HELD_OUT
    return scored.select("doc_id", F.coalesce(fold, F.lit(True)).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_passages(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_sa.sentencepiece_encode(docs, model, decoded="decoded")
    ids = F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(ids, 256).alias("ids_sha256"), F.coalesce(F.col("decoded").eqNullSafe(F.col("text")), F.lit(False)).alias("round_trip"))


def op4_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wu_manber.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_store.store_path(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_tokens(spark, path)


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.lm_scores(table(spark, sf_dir, "documents"))


def op9_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ecoc_langid.train(docs.select("doc_id", "text", "lang"))
    found = ecoc_langid.identify(docs.select("doc_id", "text"), model)
    fold = F.crc32(F.col("doc_id").cast("string")) % ecoc_langid.FOLDS == ecoc_langid.HELD_OUT
    return found.select("doc_id", F.coalesce(fold, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan_licenses(docs, license_scan.train(docs))
    return found.select("doc_id", "n_paragraphs", "n_licensed", "n_unknown", F.concat_ws(",", "licenses").alias("licenses"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return token_alignment.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.store_path(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.page_records(warc.read_archives(spark, path))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_quality_pu, op2_substring_dedup, op3_sentencepiece, op4_embedding_hnsw, op5_ngram_jaccard_join, op6_decontamination, op7_token_store, op8_deleted_interpolation, op9_ecoc_langid, op10_license_scan, op11_filter_audit, op12_token_alignment, op13_warc)}
