"""Exact dedup by progressive refinement (built-in expressions only).

1. Signature pass: byte length and a hash of the first bytes of each text, 16 bytes a row, written to shared storage.
2. Length groups refined by prefix hash: one map-side combined count gives both, since a (length, prefix) group of two
   or more lies in a length group of two or more.
3. Groups that survive go into a bitmap of fixed size (1 << filter_bits bits at most, so its broadcast is bounded).
   Rows off the bitmap are unique: they are neither hashed in full nor shuffled.
4. Rows on the bitmap are hashed in full (SHA-256), counted with map-side combining, and joined to their group's row.
   A hot group meets only in the combined counts; these are written first, so that AQE can split the join back.
A full bitmap (more repeated groups than bits) costs speed only: rows then pass to step 4 needlessly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, without

PREFIX_CHARS = 128
FILTER_BITS = 20


def repeated_words(keys: DataFrame, slot: str, bits: int) -> DataFrame:
    """Bitmap of the slots in `keys` as rows (word, bits): at most 2**(bits-6) rows of two numbers."""
    return keys.groupBy(F.shiftright(slot, 6).cast("int").alias("__w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("__bits"))


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with keep_id, group_size (long) and kept: of rows with identical text, the one with the largest key stays.

    Null text counts as empty, and empty texts are equal to each other. Rows that tie on text and key are all kept (they are
    the same document); null keys lose against any other key, and a group of null keys only has keep_id null and is kept.
    An empty table gives an empty table. Input columns named keep_id, group_size or kept are replaced.
    """
    docs = without(docs, "keep_id", "group_size", "kept")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn("__len", F.octet_length(body)).withColumn("__pre", F.xxhash64(F.substring(body, 1, prefix_chars)))
    slot = F.expr(f"pmod(xxhash64(__len, __pre), {1 << filter_bits}L)")
    groups = settle(marked.select("__len", "__pre"), "dedup-signatures").groupBy("__len", "__pre").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    bitmap = settle(repeated_words(groups.select(slot.alias("__slot")), "__slot", filter_bits), "dedup-bitmap")
    rows = marked.withColumn("__slot", slot).withColumn("__w", F.shiftright("__slot", 6).cast("int")).join(F.broadcast(bitmap), "__w", "left")
    hit = F.expr("coalesce(shiftright(__bits, cast(__slot & 63 as int)) & 1L, 0L) = 1L")
    plain = rows.where(~hit).select(*docs.columns, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    left = rows.where(hit).withColumn("__full", F.sha2(body, 256)).select(*docs.columns, "__full")
    totals = left.groupBy("__full").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    totals = settle(totals.withColumn("__again", F.lit(True)), "dedup-totals")  # written, so that AQE finds plain shuffles on both sides
    chosen = left.join(totals, "__full", "left").select(*docs.columns, F.when(F.col("__again"), F.col("keep_id")).otherwise(F.col(key)).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    chosen = chosen.withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id")))
    return plain.unionByName(chosen)
