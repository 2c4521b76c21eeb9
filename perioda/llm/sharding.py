"""K-d tree sharding (built-in expressions only).

Rows are points with metadata dimensions; every tree level cuts each node along its widest dimension (largest share of
the dimension's whole range, by weight) at the node's weighted median. Medians are found distributed: bytes are summed
per histogram bin with map-side combining, the bin with the median is refined in further rounds, so only bins, never
rows, meet. Ties in a dimension are ordered by the text's hash, then the row's. A group of equal texts that agree in the dimensions
is cut only if it weighs more than WHOLE of its node, so a hot group is cut like any other weight, and small ones stay whole at the
price of a slightly uneven cut. Nodes are halved until leaves reach the target. Each level is one job; what it leaves is a
row for each node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, without

BITS = 12  # of a code that one histogram round resolves
ROUNDS = 4  # the first three resolve a value and a text's hash, the last one rows
WHOLE = 0.01  # of a node's weight: lighter groups of equal texts aren't cut
ROWS_PER_BUCKET, MOST_BUCKETS = 4096, 1 << 20  # for the numbering: rows that one window numbers, windows at most
SETTLE = 4  # levels after which the points are written with their nodes


def _values(text: str, categories: list[str]) -> list[Column]:
    """Dimensions before scaling: length of the text, hashed order of each category."""
    return [F.log1p(F.coalesce(F.octet_length(text), F.lit(0)) + 1), *[F.expr(f"cast(crc32(coalesce(cast(`{c}` as string), '')) as double)") for c in categories]]


def _codes(values: list[Column], ends: list[tuple], text_hash: Column, row_hash: Column) -> list[Column]:
    """Each dimension as an integer of 48 bits: 16 of the value in its own range, 20 of the text's hash, 12 of the row's."""
    tie = F.pmod(text_hash, F.lit(1 << 20)) * F.lit(1 << 12) + F.pmod(row_hash, F.lit(1 << 12))
    out = []
    for v, (lo, hi) in zip(values, ends):
        scaled = F.lit(0).cast("long") if lo is None or hi <= lo else F.coalesce(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * 65535), F.lit(0)).cast("long")
        out.append(scaled * F.lit(1 << 32) + tie)
    return out


def _cut(points: DataFrame, ndim: int) -> DataFrame:
    """One level: (node, axis, cut) where cut is the code at each node's weighted median along its widest axis."""
    width = [(F.max(f"__d{i}") - F.min(f"__d{i}")).alias(f"s{i}") for i in range(ndim)]
    spans = points.groupBy("__node").agg(F.sum("__weight").alias("all"), *width)
    best = F.greatest(*[F.col(f"s{i}") for i in range(ndim)]) if ndim > 1 else F.col("s0")
    axis = reduce(lambda rest, i: F.when(F.col(f"s{i}") == best, F.lit(i)).otherwise(rest), range(ndim - 1, -1, -1), F.lit(0))
    zero = F.lit(0).cast("long")
    found = spans.select("__node", "all", axis.alias("__axis"), zero.alias("__prefix"), zero.alias("__below"), zero.alias("__w"))
    code = reduce(lambda rest, i: F.when(F.col("__axis") == i, F.col(f"__d{i}")).otherwise(rest), range(ndim), zero)
    for r in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - r)
        bins = points.join(F.broadcast(found), "__node").withColumn("__code", code)  # found has a row for each node: fewer than the shards
        bins = bins.where(F.shiftright("__code", shift + BITS) == F.col("__prefix"))
        bins = bins.groupBy("__node", F.shiftright("__code", shift).alias("__bin")).agg(F.sum("__weight").alias("w"), *[F.first(c).alias(c) for c in ("all", "__axis", "__below")], F.first("__w").alias("__group"))
        run = bins.withColumn("upto", F.col("__below") + F.sum("w").over(W.partitionBy("__node").orderBy("__bin"))).withColumn("start", F.col("__below"))
        run = run.where(F.col("upto") * 2 >= F.col("all")).groupBy("__node").agg(F.min(F.struct("__bin", "upto", "w", "all", "__axis", "start", "__group")).alias("x"))
        found = run.select("__node", F.col("x.all").alias("all"), F.col("x.__axis").alias("__axis"), F.col("x.__bin").alias("__prefix"), (F.col("x.upto") - F.col("x.w")).alias("__below"), F.col("x.w").alias("__w"), F.col("x.start").alias("__start"), F.col("x.__group").alias("__group"))
    nearer = lambda below, w: (F.abs(2 * (F.col(below) + F.col(w)) - F.col("all")) <= F.abs(2 * F.col(below) - F.col("all"))).cast("long")  # noqa: E731  of what holds the median: to the lighter side
    row = F.col("__prefix") + nearer("__below", "__w")
    group = F.shiftleft(F.shiftright("__prefix", BITS) + nearer("__start", "__group"), BITS)
    return found.select("__node", "__axis", F.when(F.col("__group") <= F.lit(WHOLE) * F.col("all"), group).otherwise(row).alias("__cut"))


def kd_shards(docs: DataFrame, *, shards: int = 16, text: str = "text", key: str = "doc_id", categories: tuple[str, ...] = ("source", "lang"), target_bytes: int | None = None) -> DataFrame:
    """docs with size, shard and slot: near equal bytes in each of `shards` (a power of two) leaves.

    size is the text's UTF-8 bytes (null: none) plus 1. Dimensions: text length and the hashed order of each category column;
    absent or null ones count as one value. Equal texts share a shard if they agree in the categories and weigh less than WHOLE of
    a node. slot numbers the rows of a shard without gaps from 0. With target_bytes the
    number of leaves is the power of two that brings the mean leaf to at most that. Repeated rows each get a slot of their
    own; a table of fewer rows than shards leaves shards empty; an empty table gives an empty one. Input columns named
    size, shard or slot are replaced. Rows that agree in all columns are numbered by one task.
    """
    docs = without(docs, "size", "shard", "slot")
    have = [c for c in categories if c in docs.columns]
    ndim = len(have) + 1
    names = [f"__v{i}" for i in range(ndim)]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    hashes = {"__hash": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "__row": F.xxhash64(*docs.columns)}
    rows = docs.withColumns({"size": size, **hashes, **dict(zip(names, _values(text, have)))})
    facts = settle(rows.select(F.col("size").alias("__weight"), "__hash", "__row", *names), "kd-facts")
    seen = facts.agg(F.sum("__weight").alias("all"), F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{i}") for c in names for i, f in enumerate((F.min, F.max))]).first()
    if target_bytes:
        shards = 1
        while (seen["all"] or 0) / shards > target_bytes:
            shards *= 2
    codes = _codes([F.col(c) for c in names], [(seen[f"{c}_0"], seen[f"{c}_1"]) for c in names], F.col("__hash"), F.col("__row"))
    dims = {f"__d{i}": c for i, c in enumerate(codes)}
    points = facts.select("__weight", *[c.alias(d) for d, c in dims.items()], F.lit(1).alias("__node"))
    place = rows.withColumns({**dims, "__node": F.lit(1)}).drop("__hash", *names)
    code = reduce(lambda rest, i: F.when(F.col("__axis") == i, F.col(f"__d{i}")).otherwise(rest), range(ndim), F.lit(0).cast("long"))
    for level in range(shards.bit_length() - 1):
        cuts = settle(_cut(points, ndim), f"kd-level-{level}")

        def down(df: DataFrame, cuts: DataFrame = cuts) -> DataFrame:
            side = F.col("__node") * 2 + F.when(code >= F.col("__cut"), F.lit(1)).otherwise(F.lit(0))
            return df.join(F.broadcast(cuts), "__node", "left").withColumn("__node", F.coalesce(side, F.col("__node") * 2)).drop("__axis", "__cut")

        points, place = down(points), down(place)
        if level % SETTLE == SETTLE - 1 and 2 << level < shards:
            points = settle(points, f"kd-points-{level}")
    place = place.withColumn("shard", (F.col("__node") - shards).cast("int")).drop("__node", *dims)
    spread = max(1, min(MOST_BUCKETS // shards, -(-seen["n"] // (shards * ROWS_PER_BUCKET))))
    place = place.withColumn("__bucket", F.pmod(F.xxhash64("__row", F.lit(1)), F.lit(spread)).cast("int"))
    counts = place.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off")), "kd-offsets")  # MOST_BUCKETS rows at most
    numbered = place.withColumn("__rn", F.row_number().over(W.partitionBy("shard", "__bucket").orderBy("__row")))
    return numbered.join(F.broadcast(offsets), ["shard", "__bucket"]).withColumn("slot", (F.col("__off") + F.col("__rn") - 1).cast("long")).drop("__bucket", "__off", "__rn", "__row")
