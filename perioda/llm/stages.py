"""Stages of the corpus pipeline: each calls one of this package's operators, and its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .bpe import encode_documents
from .common import new_folder, table
from .exact_dedup import exact_dedup
from .minhash import near_duplicates
from .mixing import mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.7  # toxicity score from which a document goes
REMEMBERED = 250_000  # pieces that a Python worker keeps, as it has served other stages before
TEMPER, KEEP = 0.8, 0.9  # of the mixture: power of the observed shares, share of the tokens to draw


def own_columns(df: DataFrame) -> DataFrame:
    """The columns of documents that the input has; other ones are not passed on."""
    return df.select(*[c for c in COLUMNS if c in df.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under REJECT; the model is fitted on the labelled documents of the corpus."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return own_columns(toxicity.score(own_columns(docs), model, out="__score").where(F.col("__score") < REJECT))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id."""
    return own_columns(exact_dedup(own_columns(docs)).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8 or more), the document with the smallest doc_id.

    Decisions join documents on doc_id: only ids are shuffled against them, and ids that stay are each used once.
    """
    decided = near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    docs = own_columns(docs)
    return docs.where("doc_id is null").unionByName(own_columns(docs.join(decided, "doc_id", "left_semi")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that bring sources, languages and topics towards their tempered token shares."""
    return own_columns(mix(own_columns(docs), temper=TEMPER, keep_share=KEEP).where("sampled"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the token ids of each document, and the hash of the bytes that they decode to."""
    rows = encode_documents(own_columns(docs).select("doc_id", "source", "lang", "text"), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, decoded="__bytes", remembered=REMEMBERED)
    return rows.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("__bytes", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None  # a trained model, MinHash candidates and byte-pair merges have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to shared storage and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
