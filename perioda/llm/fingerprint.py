"""Homomorphic multiset fingerprints of documents (built-in expressions only).

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector; the fingerprint is the
lane-wise sum of the vectors, so it doesn't depend on the order of paragraphs, and adding or taking away paragraphs is adding
or subtracting their vectors. Lanes of a vector:
  0        sentences in the paragraph, modulo 2**32
  1..4     uniform hashes of the whole paragraph, modulo 2**32 (equality)
  5..36    lanes of 20 bits, three in each long: 96 bits of the hashes of each of its sentences, counted modulo 2**20 (likeness)
With n sentences and a bit count c, 2c - n is a sum of random signs, so products of such lanes estimate how many sentences
two documents share; the cosine of the estimates is the likeness, with a standard error of 0.1 for texts that share nothing (1 / sqrt(96)) and
less the more they share. A lane wraps where one sentence stands over 1,048,575 times in a text: the likeness of such a text is off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, with_blocks

EQUAL = 4
MOD32 = 0xFFFFFFFF
BITS, SLOT, PER_LONG = 20, 21, 3  # of a lane: its bits, and those up to the next one, which take the carry
ONES = sum(1 << SLOT * j for j in range(PER_LONG))
LANES = ((1 << BITS) - 1) * ONES
HASHES, SHIFTS = 2, 16
ROWS_PER_BLOCK = 2048


def _uniform(i: int):
    return lambda a, h: (a + F.xxhash64(h, F.lit(i)).bitwiseAND(F.lit(MOD32))).bitwiseAND(F.lit(MOD32))


def _counted(i: int):
    return lambda a, h: (a + F.shiftrightunsigned(h, i).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LANES))


def _seeded(k: int):
    return lambda s: F.xxhash64(s, F.lit(k))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array<long> of lanes of the text column (null: as empty text, one empty paragraph without sentences).

    Pieces and their hashes are columns of their own: the folds over them are interpreted, and would else make them anew for each lane.
    """
    zero = F.lit(0).cast("long")
    df = df.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"__pars": F.transform(F.split("__body", "\n"), lambda p: F.xxhash64(p)), "__sents": F.filter(F.split("__body", "[.\n]"), lambda s: F.length(s) > 0)})
    df = df.withColumns({f"__bits{k}": F.transform("__sents", _seeded(k)) for k in range(HASHES)})
    lanes = [F.size("__sents").cast("long").bitwiseAND(F.lit(MOD32))]
    lanes += [F.aggregate("__pars", zero, _uniform(i)) for i in range(EQUAL)]
    lanes += [F.aggregate(f"__bits{k}", zero, _counted(i)) for k in range(HASHES) for i in range(SHIFTS)]
    return df.withColumn(out, F.array(*lanes)).drop("__body", "__pars", "__sents", *[f"__bits{k}" for k in range(HASHES)])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets of paragraphs (sign -1: of the difference)."""
    low = F.transform(F.slice(a, 1, EQUAL + 1), lambda x, i: (x + sign * F.element_at(b, i + 1)).bitwiseAND(F.lit(MOD32)))
    other = (lambda x: x) if sign > 0 else (lambda x: (F.lit(LANES) - x + F.lit(ONES)).bitwiseAND(F.lit(LANES)))
    high = F.transform(F.slice(a, EQUAL + 2, SHIFTS * HASHES), lambda x, i: (x + other(F.element_at(b, i + EQUAL + 2))).bitwiseAND(F.lit(LANES)))
    return F.concat(low, high)


def likeness(a: Column, b: Column) -> Column:
    """Cosine, cut to 0..1, of the sentence counts as the two fingerprints estimate them; 1 for equal fingerprints."""

    def signed(fp: Column) -> Column:
        def lane(x: Column, j: int) -> Column:
            v = F.pmod(2 * F.shiftrightunsigned(x, SLOT * j).bitwiseAND(F.lit((1 << BITS) - 1)) - F.element_at(fp, 1), F.lit(2 << BITS))
            return F.when(v >= 1 << BITS, v - (2 << BITS)).otherwise(v).cast("double")

        return F.flatten(F.transform(F.slice(fp, EQUAL + 2, SHIFTS * HASHES), lambda x: F.array(*[lane(x, j) for j in range(PER_LONG)])))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = signed(a), signed(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / norm))).otherwise(F.lit(0.0))


def to_string(fp: Column) -> Column:
    return F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def with_next(docs: DataFrame, columns: dict[str, str], *, key: str = "doc_id", tie: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """docs with, for {column: new name}, the column's value of the next row in descending key order (after the last: the first).

    Rows are dealt by blocks of neighbouring keys in one shuffle; each block's first row is also sent to the block above it.
    Null keys come last; rows that tie on the key follow the column `tie`, a hash. The table of first rows has a row of a few numbers
    for each block, 524,288 at most (with_blocks), so the window over it and its broadcast are bounded.
    """
    docs = with_blocks(docs, key, tie, rows_per_block)
    heads = docs.groupBy("__block").agg(F.max(F.struct(F.col(key).cast("long").alias("k"), F.col(tie).alias("t"))).alias("__head"))
    around = W.orderBy(F.desc("__block"))
    heads = heads.withColumn("__to", F.coalesce(F.lag("__block").over(around), F.min("__block").over(W.partitionBy())))
    heads = settle(heads, "neighbour-heads").select(F.col("__block").alias("__hb"), F.col("__head.k").alias("__hk"), F.col("__head.t").alias("__ht"), "__to")
    rows = docs.join(F.broadcast(heads), (F.col("__block") == F.col("__hb")) & F.col(key).eqNullSafe(F.col("__hk")) & (F.col(tie) == F.col("__ht")), "left")
    own = F.struct(F.col("__block").alias("b"), F.lit(0).alias("s"))
    sent = F.struct(F.col("__to").alias("b"), F.lit(1).alias("s"))
    places = F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, sent))
    rows = rows.withColumn("__at", F.explode(places)).withColumn("__b", F.col("__at.b")).withColumn("__s", F.col("__at.s"))
    w = W.partitionBy("__b").orderBy("__s", F.desc_nulls_last(key), F.desc(tie))
    rows = rows.withColumns({new: F.lead(c).over(w) for c, new in columns.items()})
    return rows.where("__s = 0").drop("__block", "__hb", "__hk", "__ht", "__to", "__at", "__b", "__s")


def fingerprint_edits(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited form, which ends in the start of the next document (descending key).

    Returns key, n_chars, edited (the text), fp and edited_fp (array<long>), near_edited and near_next. Null text counts as
    empty; an empty table gives an empty one; ties on the key are ordered by the text's hash; other columns are not read.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = with_fingerprint(rows.withColumn("__tie", F.xxhash64("__text")), "__text", "fp")
    rows = with_next(rows, {"__text": "__next", "fp": "__next_fp"}, key=key, tie="__tie")
    n = F.length("__text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("__text"), F.lit(1), n - third), F.substring(F.col("__next"), F.lit(1), third)))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(key, "n_chars", "edited", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("__next_fp")).alias("near_next"))
