"""Frequency conversion: aggregation to fewer periods a year, repetition and interpolation to more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import periods
from .frame import S, T, TsFrame, V

CONVERTIBLE = (1, 2, 4, 12, 366)
# Fixed values of daily interpolation, (365-day year, leap year) by period: days of the year that stand for a period's centre, and
# the days that a quarter spans from its begin or centre to the next.
CENTRE_DAY = {1: ((182, 183),), 2: ((91, 92), (274, 275)), 4: ((46, 46), (135, 136), (196, 197), (319, 320))}
QUARTER_SPAN = {
    "interp_begin": ((90, 91), (91, 91), (92, 92), (93, 92)),
    "interp_center": ((89, 90), (92, 92), (92, 92), (93, 92)),
    "interp_end": ((91, 91), (92, 92), (92, 92)),
}


def convert(x: TsFrame, freq: int | str, method: str | None = None, strict: bool = False) -> TsFrame:
    """x at another frequency: lower needs a method (sum, nsum, average, naverage, stock, nstock), higher has repeat or
    interp_begin, interp_center, interp_end; the same gives x. strict: a series without a complete lower period is an error at run time."""
    f = periods.frequency(freq)
    if f not in CONVERTIBLE or x.freq not in CONVERTIBLE:
        raise ValueError("only yearly, half-yearly, quarterly, monthly and daily series are converted")
    if f == x.freq:
        return x
    return aggregate(x, f, method, strict) if f < x.freq else disaggregate(x, f, method)


def aggregate(x: TsFrame, f: int, method: str | None, strict: bool = False) -> TsFrame:
    """Complete target periods only; stock and nstock need a period's last slot alone. A series without any goes, or with strict is an error at run time."""
    method = {"ave": "average", "nave": "naverage"}.get((method or "").lower(), (method or "").lower())
    if method not in ("sum", "nsum", "average", "naverage", "stock", "nstock"):
        raise ValueError("aggregation needs a method: sum, nsum, average, naverage, stock or nstock")
    t, df = F.col(T), x.df
    if x.freq == 366:
        day = periods.t_to_date(t, 366)
        df = df.withColumn("__d", day).where("__d is not null").withColumn("__t2", periods.date_to_t(F.col("__d"), f))
        first, last = periods.t_to_date(F.col("__t2"), f, False), periods.t_to_date(F.col("__t2"), f, True)
        df = df.withColumns({"__n": (F.datediff(last, first) + 1).cast("long"), "__end": F.col("__d") == last})
    else:
        ratio = x.freq // f
        df = df.withColumns({"__t2": F.floor(t / ratio).cast("long"), "__n": F.lit(ratio).cast("long"), "__end": F.pmod(t, F.lit(ratio)) == ratio - 1})
    value = {
        "sum": F.when(F.count(V) == F.count(F.lit(1)), F.sum(V)),
        "nsum": F.sum(V),
        "average": F.when(F.count(V) == F.count(F.lit(1)), F.avg(V)),
        "naverage": F.avg(V),
        "stock": F.max_by(V, T),
        "nstock": F.max_by(V, F.when(F.col(V).isNotNull(), t)),
    }[method]
    whole = F.bool_or("__end") if method in ("stock", "nstock") else F.count(F.lit(1)) == F.max("__n")
    made = df.groupBy(S, "__t2").agg(value.alias(V), whole.alias("__whole"))
    if strict:
        some = F.bool_or("__whole").over(W.partitionBy(S))  # over a series' target periods: few rows
        made = made.withColumn("__some", some).where(F.expr("if(not __some, raise_error(concat('series ', __series, ' has no complete period')), true)"))
    made = made.where("__whole")
    return TsFrame(made.select(S, F.col("__t2").alias(T), V), f, x.meta)


def _daily_bound(t: Column, f: int, last: bool) -> Column:
    """Daily ordinal of a period's first or last day; a year's end is slot 366 in every year."""
    d = periods.t_to_date(t, f, last)
    doy = F.when((F.month(d) == 12) & (F.dayofmonth(d) == 31), F.lit(366)).otherwise(F.dayofyear(d)) if last else F.dayofyear(d)
    return F.year(d).cast("long") * 366 + doy - 1


def disaggregate(x: TsFrame, f: int, method: str | None) -> TsFrame:
    method = {"null": "repeat", "duplicate": "repeat"}.get((method or "repeat").lower(), (method or "repeat").lower())
    if method == "repeat":
        lo, hi = (_daily_bound(F.col(T), x.freq, False), _daily_bound(F.col(T), x.freq, True)) if f == 366 else (F.col(T) * (f // x.freq), F.col(T) * (f // x.freq) + f // x.freq - 1)
        return TsFrame(x.df.select(S, F.explode(F.sequence(lo, hi)).alias("__t2"), V).select(S, F.col("__t2").alias(T), V), f, x.meta)
    if method not in ("interp_begin", "interp_center", "interp_end"):
        raise ValueError(f"unknown method: {method}")
    return TsFrame(_interpolated(x, f, method), f, x.meta)


def _pick(pairs: tuple, leap: Column, p: Column) -> Column:
    out = F.lit(None).cast("long")
    for i in range(len(pairs) - 1, -1, -1):
        out = F.when(p == i + 1, F.when(leap, F.lit(pairs[i][1])).otherwise(F.lit(pairs[i][0])).cast("long")).otherwise(out)
    return out


def _daily_anchor(t: Column, f: int, method: str) -> Column:
    first = F.dayofyear(periods.t_to_date(t, f, False)).cast("long")
    y, p = periods.year_of(t, f), periods.period_of(t, f)
    if method == "interp_begin":
        day = first
    elif method == "interp_end":
        day = F.dayofyear(periods.t_to_date(t, f, True)).cast("long")
    else:
        day = first + 14 if f == 12 else _pick(CENTRE_DAY[f], periods.leap(y), p)
    return y.cast("long") * 366 + day - 1


def _interpolated(x: TsFrame, f: int, method: str):
    """Rows between neighbours' anchors on a straight line; a series of one value gives that value's anchor alone."""
    w, t = TsFrame.by_time(), F.col(T)
    if f != 366:
        ratio = f // x.freq
        anchor = t * ratio + {"interp_begin": 0, "interp_center": ratio // 2, "interp_end": ratio - 1}[method]
        df = x.df.withColumn("__at", anchor)
    else:
        df = x.df.withColumn("__own", _daily_anchor(t, x.freq, method))
        if x.freq == 4:
            y, p = periods.year_of(t, 4), periods.period_of(t, 4)
            span = _pick(QUARTER_SPAN[method], periods.leap(y), p)
            if method == "interp_end":
                span = F.when(p == 4, F.when(periods.leap(y), F.lit(90)).when(periods.leap(y + 1), F.lit(92)).otherwise(F.lit(91)).cast("long")).otherwise(span)
        else:
            span = _daily_anchor(t + 1, x.freq, method) - F.col("__own")
        df = df.withColumn("__span", span)
        run = w.rowsBetween(W.unboundedPreceding, -1)  # anchors are the first one plus the spans since
        df = df.withColumn("__at", F.first("__own").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("__span").over(run), F.lit(0)))
    df = df.withColumns({"__next": F.lead(V).over(w), "__width": F.lead("__at").over(w) - F.col("__at")})
    df = df.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__width") - 1, F.lit(0).cast("long")))))
    value = F.when(F.col("__step") == 0, F.col(V)).otherwise(F.col(V) + F.col("__step") * (F.col("__next") - F.col(V)) / F.col("__width"))
    return df.select(S, (F.col("__at") + F.col("__step")).alias("__t2"), value.alias("__v")).select(S, F.col("__t2").alias(T), F.col("__v").alias(V))
