"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractions import Fraction

import public_tokenizers

from . import toxicity
from .bpe import encoding_digests
from .common import table
from .exact_dedup import exact_dedup
from .fingerprint import fingerprint_edits, to_string
from .minhash import near_duplicates
from .mixing import mix
from .sharding import kd_shards
from .suffix import remove_repeats
from .tokenstore import store_and_read
from .warc import archive_pages


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = exact_dedup(docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint_edits(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_string(F.col("fp")).alias("fingerprint"), to_string(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", "fitted_share", "probability", "sampled")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_pages(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def training_rows(key: str = "doc_id"):
    """Rows whose labels may be learnt: crc32 of the id's decimal text, modulo 3, is not 1."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=training_rows())
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", F.coalesce(~training_rows(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut by length and language; sources would part equal texts, as copies of a text stand in several."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = kd_shards(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), categories=("lang",))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, least=Fraction(85, 100))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encoding_digests(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
