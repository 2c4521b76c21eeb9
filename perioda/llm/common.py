"""Helpers shared by the training-data operators: shared storage, cut lineage, ordered blocks."""

from __future__ import annotations

import math
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset and all runs on one machine (tests), one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        where = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


# How Spark and pyarrow name the same stores.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a folder as Spark names it."""
    for spark, arrow in SCHEMES.items():
        if folder.startswith(spark):
            folder = arrow + folder[len(spark) :].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, empty place below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, through Spark's own file system layer."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add: its outputs win over inputs of the same name."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def on_one_machine(spark: SparkSession) -> bool:
    """Whether all tasks run on the driver's machine."""
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def tree(value: Column, cuts: list, leaf, lo: int = 0) -> Column:
    """Balanced search of value among sorted cuts: leaf(i), i the number of cuts <= value."""
    if not cuts:
        return leaf(lo)
    mid = len(cuts) // 2
    return F.when(value < F.lit(cuts[mid]), tree(value, cuts[:mid], leaf, lo)).otherwise(tree(value, cuts[mid + 1 :], leaf, lo + mid + 1))


CELLS, FAN, DEEPEST = 128, 64, 2  # first cut, further cuts of each, levels of those: CELLS * FAN**DEEPEST = 524,288 blocks at most
LOWEST = -(1 << 63)


def with_blocks(df: DataFrame, key: str, tie: str, rows_per_block: int, out: str = "__block") -> DataFrame:
    """df with `out`, a block number that rises with (key, tie): about rows_per_block rows each, in at most 524,288 blocks.

    key: a long, nulls lowest; tie: a long that is spread evenly, such as a hash. Quantiles of the key cut the table into CELLS cells, those of
    each cell cut it into FAN, and so on while blocks are too large: however the keys cluster, blocks are of about one size. A key
    that spans several quantiles is cut by its ties; only rows that agree in both can't be parted. The driver gets the first
    quantiles alone; a further level is a broadcast table of a row for each node (8,192 arrays of 63 numbers at most).
    """
    df = df.withColumn("__v", F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))).withColumn("__f", F.col(tie) / F.lit(2.0**64) + F.lit(0.5))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", [i / CELLS for i in range(1, CELLS)], 10_000).alias("q")).first()
    blocks = math.ceil(row["n"] / rows_per_block)
    cells = max(1, min(CELLS, blocks))
    cuts = [int(row["q"][round(i * CELLS / cells) - 1]) for i in range(1, cells)] if row["n"] else []
    apart = sorted(set(cuts))
    upto = [0, *[sum(c <= d for c in cuts) for d in apart]]

    def ends(i: int) -> Column:
        """Least and greatest place of a value with i of the different cuts at or below it."""
        last = F.lit(upto[i]).cast("long")
        if not i:
            return F.array(last, last)
        return F.array(F.when(F.col("__v") == F.lit(apart[i - 1]), F.lit(upto[i - 1]).cast("long")).otherwise(last), last)

    def placed(rows: DataFrame) -> DataFrame:
        """__ends to a place among them by the tie; what is left of the tie goes on to the next level."""
        steps = F.element_at("__ends", 2) - F.element_at("__ends", 1)
        rows = rows.withColumn("__g", F.col("__f") * (steps + 1)).withColumn("__o", F.least(F.floor("__g"), steps))
        return rows.withColumn("__f", F.col("__g") - F.col("__o")).withColumn("__place", F.element_at("__ends", 1) + F.col("__o")).drop("__ends", "__g", "__o")

    df = placed(df.withColumn("__ends", tree(F.col("__v"), apart, ends))).withColumn(out, F.col("__place")).drop("__place")
    size = cells
    for level in range(DEEPEST):
        if size >= blocks:
            break
        fan = min(FAN, math.ceil(blocks / size))
        cut = settle(df.groupBy(F.col(out).alias("__node")).agg(F.percentile_approx("__v", [i / fan for i in range(1, fan)], 10_000).alias("__cuts")), f"blocks-{level}")
        low, high = F.filter("__cuts", lambda c: c < F.col("__v")), F.filter("__cuts", lambda c: c <= F.col("__v"))
        df = df.join(F.broadcast(cut), F.col(out) == F.col("__node"))
        df = placed(df.withColumn("__ends", F.array(F.size(low).cast("long"), F.size(high).cast("long"))))
        df = df.withColumn(out, F.col(out) * fan + F.col("__place")).drop("__node", "__cuts", "__place")
        size *= fan
    return df.drop("__v", "__f")
