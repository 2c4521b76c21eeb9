"""Mixing sources to target weights (built-in expressions only).

Documents are reduced to cells (source, language, topic) with their token weights. Iterative proportional fitting rakes
the cells: in turn each margin's cells are scaled so that the margin meets its target, until no margin is off by more than
the tolerance. A document's calibrated probability follows from its cell: fitted over actual weight, scaled so that
the largest is 1. A hash of the key, compared with the probability, draws the sample: the same rows on every run and retry.
Cells meet by margin value only, after map-side combining; a hot source is one sum, not one group of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, without

MARGINS = ("source", "lang", "topic")
TEMPER = 0.5  # default targets: shares to this power
TOPICS = 8
ROUNDS_PER_JOB, JOBS, TOLERANCE = 4, 8, 1e-6
HASH_STEPS = 1 << 30


def words(text: Column) -> Column:
    """Tokens of a text for weights: runs of characters between spaces and line ends, at least 1."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   "))
    return (F.length(flat) - F.length(F.translate(flat, " ", "")) + 1).cast("long")


def with_topic(docs: DataFrame, text: str, topics: int = TOPICS) -> DataFrame:
    """docs with a stand-in topic where the table has none: the class that most of the text's words of 5 letters or more hash to
    (the least class in ties; 't0' without such words). Words are hashed once; counts of classes are differences of array sizes."""
    tokens = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\n\t\r", "   "), " "), lambda w: F.length(w) >= 5)
    classes = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(topics)).cast("int"))
    counts = [F.struct((F.size("__classes") - F.size(F.array_remove("__classes", k))).alias("n"), F.lit(-k).alias("c")) for k in range(topics)]
    return docs.withColumn("__classes", classes).withColumn("topic", F.concat(F.lit("t"), (-F.greatest(*counts)["c"]).cast("string"))).drop("__classes")


def default_targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """(value, share): each value's share of the weight, to the power `temper`, scaled to sum to 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("weight").alias("w"))
    total = sums.agg(F.sum(F.pow("w", F.lit(temper))).alias("all"))
    return sums.join(F.broadcast(total)).select("value", (F.pow("w", F.lit(temper)) / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, tolerance: float = TOLERANCE, jobs: int = JOBS) -> DataFrame:
    """cells with `fitted`: weights (summing to 1) whose margins meet the targets as nearly as `jobs` rounds of jobs allow.

    Values without a target keep a share of 0; targets without cells are left out and the rest scaled up.
    """
    fitted = cells.withColumn("fitted", F.col("weight").cast("double"))
    for m, t in targets.items():
        share = t.select(F.col("value").alias("__v"), F.col("share").alias(f"__t_{m}"))
        fitted = fitted.join(share, F.col(m).eqNullSafe(F.col("__v")), "left").drop("__v")
    present = {m: fitted.groupBy(m).agg(F.max(F.coalesce(f"__t_{m}", F.lit(0.0))).alias("s")).agg(F.sum("s")).first()[0] or 1.0 for m in targets}
    for m, s in present.items():
        fitted = fitted.withColumn(f"__t_{m}", F.coalesce(F.col(f"__t_{m}"), F.lit(0.0)) / F.lit(float(s)))
    for job in range(jobs):
        for _ in range(ROUNDS_PER_JOB):
            for m in targets:
                now = F.sum("fitted").over(W.partitionBy(m))
                fitted = fitted.withColumn("fitted", F.when(now > 0, F.col("fitted") * F.col(f"__t_{m}") / now).otherwise(F.lit(0.0)))
        fitted = settle(fitted, f"rake-{job}")
        off = [fitted.groupBy(m).agg(F.abs(F.sum("fitted") - F.max(f"__t_{m}")).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("d")) for m in targets]
        if max(x[0] for x in reduce(DataFrame.unionByName, off).collect()) <= tolerance:  # a row for each margin
            break
    return fitted.drop(*[f"__t_{m}" for m in targets])


def mix(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, text: str = "text", key: str = "doc_id", temper: float = TEMPER, keep_share: float | None = None, seed: int = 7) -> DataFrame:
    """docs with topic (where absent), n_tokens, fitted_share, probability and sampled.

    targets: {margin: (value, share) table} for source, lang and topic; tempered shares where missing. keep_share: the share of
    all tokens expected in the sample (probabilities are cut at 1); without it the largest probability is 1. Null margins are
    a value like any other; null text counts one token. Repeated rows share a draw, as the draw depends on key and seed alone
    (null keys: on the text). An empty table gives an empty one. Input columns named as outputs are replaced, topic excepted.
    """
    docs = without(docs, "n_tokens", "fitted_share", "probability", "sampled")
    if "topic" not in docs.columns:
        docs = with_topic(docs, text)
    for m in ("source", "lang"):
        if m not in docs.columns:
            docs = docs.withColumn(m, F.lit(None).cast("string"))
    docs = settle(docs.withColumn("n_tokens", words(F.col(text))), "mix-documents")  # read twice, their words counted once
    cells = settle(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("weight")), "mix-cells")
    goals = {m: (targets or {}).get(m) for m in MARGINS}
    goals = {m: default_targets(cells, m, temper) if t is None else t for m, t in goals.items()}
    fitted = rake(cells, goals)
    ratio = F.col("fitted") / F.col("weight")
    sums = fitted.agg(F.max(ratio).alias("top"), F.sum("weight").alias("all")).first()
    top = float(sums["top"] or 1.0)
    scale = 1.0 / top if keep_share is None else keep_share * float(sums["all"] or 1)
    chosen = fitted.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("fitted").alias("fitted_share"), F.least(F.lit(1.0), ratio * F.lit(scale)).alias("probability"))
    same = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in MARGINS])
    draw = F.expr(f"pmod(xxhash64({seed}, coalesce(cast(`{key}` as string), `{text}`)), {HASH_STEPS}L)") / F.lit(float(HASH_STEPS))
    small = fitted.count() <= 100_000
    rows = docs.join(F.broadcast(chosen) if small else chosen, same)
    return rows.drop(*[f"__{m}" for m in MARGINS]).withColumn("sampled", draw < F.col("probability"))
