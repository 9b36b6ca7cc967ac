"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepair, knn, license_scan, paragraphs, resample, simhash, tiling, token_count, toxicity, warc
from ._shared import table, text_of


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").alias("n_items"),
        F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("max_coverage"),
        F.array_sort("leaks.item_id").alias("item_ids"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(text_of("text")).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.col("metadata.fields")
    return warc.captured(table(spark, sf_dir, "pages")).select(
        fields["page-id"].cast("long").alias("page_id"),
        F.coalesce("capture.payload_bytes", fields["payload-length"].cast("long")).alias("payload_bytes"),
        F.coalesce("capture.payload_sha1", "capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        fields["refers-to-page-id"].cast("long").alias("refers_to"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.digest(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bytepair.encoded(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, back="decoded")
    ids = F.col("ids")
    return done.select(
        "doc_id",
        F.when(ids == "", F.lit(0)).otherwise(F.octet_length(ids) - F.octet_length(F.replace(ids, F.lit(","), F.lit(""))) + 1).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(table(spark, sf_dir, "documents")).drop("ids")


def queries() -> dict:
    return {
        "op1_quality_resampling": op1_quality_resampling,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_license_scan": op3_license_scan,
        "op4_token_counts": op4_token_counts,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_toxicity": op6_toxicity,
        "op7_warc": op7_warc,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict:
    from . import oracle

    return oracle.oracle_sql()
