"""Models over Spark: expressions and residual checks as plain projections, everything iterative as one task for each group of rows.

Frames are wide: a column for each variable, __t (ordinals), and perhaps group columns (scenarios, countries, draws). Groups are the unit of
scale: each is solved in one task, whose rows are those of a model's data, and any number of groups is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ieee
from . import simulate as sim
from .data import Data
from .estimate import estimate
from .expr import Binary, Call, Expression, Number, Unary, Variable, lowered, offsets, parse_expression, shifted
from .parse import Behavioral, Equation, Model, load_model
from .simulate import coefficients_of


def column(e: Expression, groups: list[str] = ()) -> Column:
    """An expression as a Column of a wide frame. Lags and leads are taken of base columns only, over one window."""
    w = W.partitionBy(*groups).orderBy("__t")

    def build(x: Expression) -> Column:
        if isinstance(x, Number):
            return F.lit(x.value)
        if isinstance(x, Variable):
            c = F.col(f"`{x.name}`")
            return c if not x.offset else F.lag(c, -x.offset).over(w) if x.offset < 0 else F.lead(c, x.offset).over(w)
        if isinstance(x, Unary):
            return -build(x.arg) if x.op == "-" else build(x.arg)
        if isinstance(x, Call):
            return {"ABS": F.abs, "EXP": ieee.exp, "LOG": ieee.ln}[x.name](build(x.arg))
        a, b = build(x.left), build(x.right)
        arithmetic = {"+": ieee.add, "-": ieee.sub, "*": ieee.mul, "/": ieee.div, "^": ieee.power}
        if x.op in arithmetic:
            return arithmetic[x.op](a, b)
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op] if x.op not in "&|" else (a & b if x.op == "&" else a | b)

    return build(lowered(e))


def evaluate_frame(df: DataFrame, text: str, groups: list[str] = (), name: str = "value") -> DataFrame:
    """Groups, __t and the value of an expression, on the periods where all its shifted variables have a row."""
    e = parse_expression(text)
    every = [o for s in offsets(e).values() for o in s] or [0]
    back, ahead = max(0, -min(every)), max(0, max(every))
    w = W.partitionBy(*groups).orderBy("__t")
    rows = df.withColumns({name: column(e, groups), "__b": F.lag("__t", back).over(w), "__a": F.lead("__t", ahead).over(w)})
    return rows.where("__b is not null and __a is not null").select(*groups, "__t", name)


def halo(df: DataFrame, model: Model, lo: int, hi: int) -> DataFrame:
    """Only the model's columns and the periods that a range needs: the filter is set below the windows, where Spark wouldn't push it."""
    return df.where(F.col("__t").between(lo - max(model.max_lag, 1), hi + model.max_lead))


def residual_check_frame(df: DataFrame, model: Model, coefficients: dict, lo: int, hi: int, groups: list[str] = ()) -> DataFrame:
    """Fitted values and tracking add-factors of all equations from history alone: one projection. (groups, __series, __t, fitted, add_factor)"""
    made: list[Column] = []
    coefficients = coefficients_of(coefficients)

    def inverse(e: Equation, r: Column) -> Column:
        y = column(Variable(e.dependent, -e.periods), groups)
        return {"IDENTITY": lambda: r, "LOG": lambda: ieee.exp(r), "EXP": lambda: ieee.ln(r), "TSDELTA": lambda: y + r, "TSDELTALOG": lambda: ieee.exp(ieee.ln(y) + r), "TSDELTAP": lambda: y * (1.0 + r / 100.0)}[e.function]()

    def left(e: Equation, shift: int = 0) -> Expression:
        v = Variable(e.dependent)
        return shifted(lowered(v if e.function == "IDENTITY" else Call(e.function, v, e.periods)), shift)

    def base(b: Behavioral, shift: int) -> Expression:
        out: Expression | None = None
        for c, r, k in b.terms():
            term = Binary("*", Number(coefficients[b.name][c]), shifted(lowered(r), shift - k))
            out = term if out is None else Binary("+", out, term)
        return out

    for n in model.endogenous:
        actual = F.col(f"`{n}`")
        if n in model.behaviorals:
            b = model.behaviorals[n]
            rhs = base(b, 0)
            for k in range(1, b.error_order + 1):
                rhs = Binary("+", rhs, Binary("*", Number(coefficients[n][f"RHO_{k}"]), Binary("-", left(b.equation, -k), base(b, -k))))
            r = column(rhs, groups)
            fitted, gap = inverse(b.equation, r), column(left(b.equation), groups) - r
        else:
            fitted, gap = actual, F.lit(0.0)
            for condition, e in reversed(model.identities[n].alternatives):
                r = column(e.rhs, groups)
                f, g = inverse(e, r), column(left(e), groups) - r
                if condition is None:
                    fitted, gap = f, g
                else:
                    c = F.coalesce(column(condition, groups), F.lit(False))
                    fitted, gap = F.when(c, f).otherwise(fitted), F.when(c, g).otherwise(gap)
        made.append(F.struct(F.lit(n).alias("__series"), fitted.alias("fitted"), gap.alias("add_factor")))
    own = halo(df, model, lo, hi)
    rows = own.select(*groups, "__t", F.array(*made).alias("__all")).where(F.col("__t").between(lo, hi))
    return rows.select(*groups, "__t", F.explode("__all").alias("__e")).select(*groups, "__e.__series", "__t", "__e.fitted", "__e.add_factor")


def per_group(df: DataFrame, groups: list[str], schema: str, function: Callable[[Data, pd.DataFrame], pd.DataFrame], freq: int) -> DataFrame:
    """function(data, rows) for each group, in a task; group columns are put before its columns (schema)."""
    keyed = df if groups else df.withColumn("__one", F.lit(0))
    keys = list(groups) or ["__one"]
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(Data.from_wide(pdf.drop(columns=keys), freq), pdf)
        for i, g in enumerate(groups):
            out.insert(i, g, pdf[g].iloc[0])
        return out

    head = "".join(f"`{g}` {kinds[g]}, " for g in groups)
    return keyed.groupBy(*keys).applyInPandas(run, head + schema)


def estimate_frame(df: DataFrame, model_text: str, freq: int, groups: list[str] = (), **how) -> DataFrame:
    """Coefficients of all equations, estimated for each group."""

    def own(data: Data, _) -> pd.DataFrame:
        return estimate(load_model(model_text=model_text), data, **how).summary()

    return per_group(df, list(groups), "equation string, coefficient string, estimate double, std_error double, t_statistic double, p_value double", own, freq)


def simulate_frame(df: DataFrame, model_text: str, freq: int, time_range, groups: list[str] = (), **how) -> DataFrame:
    """Solutions (groups, __series, __t, value) for each group."""

    def own(data: Data, _) -> pd.DataFrame:
        return sim.simulate(load_model(model_text=model_text), data, time_range, **how).summary()

    return per_group(df, list(groups), "__series string, __t long, value double", own, freq)


def stochastic_frame(df: DataFrame, model_text: str, freq: int, time_range, disturbances: dict, groups: list[str] = (), **how) -> DataFrame:
    """Realizations (groups, __series, __t, __replica, value); replica 0 is the baseline. A group's replicas share convergence."""

    def own(data: Data, _) -> pd.DataFrame:
        return sim.stochastic_simulate(load_model(model_text=model_text), data, time_range, disturbances, **how).long()

    return per_group(df, list(groups), "__series string, __t long, __replica int, value double", own, freq)


def independent_replicas(df: DataFrame, model_text: str, freq: int, time_range, disturbances: dict, *, replicas: int, seed: int, buckets: int = 8, **how) -> DataFrame:
    """As stochastic_frame for one data set, but replicas are dealt to `buckets` tasks and converge on their own.

    Draws are those of one stream, made anew in each task, which keeps its own columns.
    """
    spread = df.crossJoin(F.broadcast(df.sparkSession.range(buckets).withColumnRenamed("id", "__bucket")))  # a copy of the data for each task

    def own(data: Data, rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["__bucket"].iloc[0])
        mine = np.arange(bucket, replicas, buckets)
        model = load_model(model_text=model_text)
        start, end = data.ordinal(time_range[0]), data.ordinal(time_range[1])
        parts = []
        drawn = sim._draws(disturbances, data, start, end, replicas, seed)
        for r in mine:
            moves = {}
            for n, (at, v, kind) in drawn.items():
                value = v[:, [r]] if kind == "MATRIX" or n in model.endogenous else data.window(n, start, end)[at][:, None] + v[:, [r]]
                spans = tuple((t // freq, t % freq + 1) for t in (start + int(at[0]), start + int(at[-1])))
                moves[n] = sim.Disturbance("MATRIX", value, spans)
            s = sim.stochastic_simulate(model, data, time_range, moves, replicas=1, seed=0, **how)
            parts += [pd.DataFrame({"__series": n, "__t": np.arange(start, end + 1), "__replica": int(r) + 1, "value": m[:, 0]}) for n, m in s.realizations.items()]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"__series": [], "__t": [], "__replica": [], "value": []})

    return per_group(spread, ["__bucket"], "__series string, __t long, __replica int, value double", own, freq).drop("__bucket")


def replica_statistics(realizations: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Mean and standard deviation over replicas."""
    return realizations.where("__replica > 0").groupBy(*groups, "__series", "__t").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def multiplier_frame(df: DataFrame, model_text: str, freq: int, time_range, targets, instruments, groups: list[str] = (), **how) -> DataFrame:
    def own(data: Data, _) -> pd.DataFrame:
        return sim.multiplier_matrix(load_model(model_text=model_text), data, time_range, targets, instruments, **how).long()

    return per_group(df, list(groups), "target string, response_t long, instrument string, shock_t long, value double", own, freq)


def renormalize_frame(df: DataFrame, model_text: str, freq: int, time_range, targets: dict, instruments, groups: list[str] = (), **how) -> DataFrame:
    """Instruments (groups, __series, __t, value) that bring the targets about."""

    def own(data: Data, _) -> pd.DataFrame:
        r = sim.renormalize(load_model(model_text=model_text), data, time_range, targets, instruments, **how)
        return pd.concat([pd.DataFrame({"__series": n, "__t": np.arange(r.start, r.start + len(v)), "value": v}) for n, v in r.instruments.items()], ignore_index=True)

    return per_group(df, list(groups), "__series string, __t long, value double", own, freq)


def optimize_frame(df: DataFrame, model_text: str, freq: int, time_range, bounds: dict, objectives, restrictions=(), groups: list[str] = (), **how) -> DataFrame:
    """(groups, __replica, objective, feasible) of every candidate; `best_candidate` picks."""

    def own(data: Data, _) -> pd.DataFrame:
        o = sim.optimize_model(load_model(model_text=model_text), data, time_range, bounds, objectives, restrictions, **how)
        return pd.DataFrame({"__replica": np.arange(1, o.replicas + 1), "objective": o.objective, "feasible": o.feasible})

    return per_group(df, list(groups), "__replica int, objective double, feasible boolean", own, freq)


def best_candidate(candidates: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Largest feasible objective (the first in ties), with mean and deviation over the feasible."""
    ok = candidates.where("feasible and objective is not null")
    best = F.max(F.struct(F.col("objective").alias("o"), (-F.col("__replica")).alias("r")))
    rows = ok.groupBy(*groups).agg(best.alias("b"), F.avg("objective").alias("ave"), F.stddev_samp("objective").alias("sd"), F.count(F.lit(1)).alias("feasible"))
    return rows.select(*groups, (-F.col("b.r")).alias("__replica"), F.col("b.o").alias("max"), "ave", "sd", "feasible")
