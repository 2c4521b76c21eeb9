"""Regular time series as a Spark DataFrame: rows (__series, __t, value), one for each period of a series, missing ones too.

A TsFrame holds any number of series of one frequency. Operations are lazy DataFrame plans keyed by __series, so they scale
over series; nothing but plan parameters lives on the driver. A frame of one series may be combined with another whatever
their names; frames of several series are combined series by series. A value of BOOLEAN type makes the frame a mask.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ieee, periods

S, T, V = "__series", "__t", "value"
Yp = tuple[int, int]
# Of rows (__k, value), k from 0: the first value, looking on only while the next k is there.
FIRST_UNBROKEN = """aggregate(array_sort(collect_list(struct(__k, value))),
    cast(struct(0, null, false) as struct<next: int, v: double, done: boolean>),
    (s, x) -> if(s.done or x.__k <> s.next, s, named_struct('next', s.next + 1, 'v', x.value, 'done', x.value is not null)), s -> s.v)"""


class TsFrame:
    """Series of one frequency. df: (__series string, __t long, value double or boolean)."""

    def __init__(self, df: DataFrame, freq: int | str, meta: dict[str, dict] | None = None) -> None:
        self.df, self.freq, self.meta = df.select(S, T, V), periods.frequency(freq), dict(meta or {})

    # ---- making frames

    @classmethod
    def of(cls, spark: SparkSession, values: Iterable[float | None], start: Yp = (2000, 1), freq: int | str = 1, name: str = "x", **meta) -> TsFrame:
        """One series from values; source, title, units and scale_factor go to its metadata."""
        values = [None if v is None or v != v else float(v) for v in values]
        if not values:
            raise ValueError("a series needs values")
        scale = meta.pop("scale_factor", 0)
        if isinstance(scale, bool) or not isinstance(scale, int) or scale < 0:
            raise ValueError("scale_factor must be a whole number of at least 0")
        f = periods.frequency(freq)
        y, p = periods.normalize_year_period(start, f)
        if not 1 <= y <= 9999:
            raise ValueError("years must lie between 1 and 9999")
        t0 = periods.ordinal(y, p, f)
        df = spark.createDataFrame([(name, t0 + i, v) for i, v in enumerate(values)], f"{S} string, {T} long, {V} double")
        own = {k: v for k, v in meta.items() if v is not None} | ({"scale_factor": scale} if scale else {})
        return cls(df, f, {name: own} if own else None)

    @classmethod
    def from_rows(cls, df: DataFrame, freq: int | str, *, series: str = "series", t: str = "t", value: str = "value") -> TsFrame:
        """Frame from rows (series, t, value) with gaps: the periods between a series' first and last are filled as missing."""
        own = df.select(F.col(series).cast("string").alias(S), F.col(t).cast("long").alias(T), ieee.clean(F.col(value).cast("double")).alias(V))
        return cls(densify(own), freq)

    def keep(self, df: DataFrame) -> TsFrame:
        """A frame of the same frequency and metadata."""
        return TsFrame(df, self.freq, self.meta)

    def drop_meta(self, df: DataFrame) -> TsFrame:
        return TsFrame(df, self.freq)

    # ---- windows

    @staticmethod
    def by_time() -> W:
        return W.partitionBy(S).orderBy(T)

    @staticmethod
    def whole() -> W:
        return W.partitionBy(S)

    def ordinal(self, yp: Yp | int) -> int:
        return yp if isinstance(yp, int) else periods.ordinal(*periods.normalize_year_period(tuple(yp), self.freq), self.freq)

    # ---- selection

    def project(self, start: Yp | None = None, end: Yp | None = None, extend: bool = False) -> TsFrame:
        """Periods from start to end: those there are, or with extend exactly these, the others missing."""
        a, b = (None if x is None else self.ordinal(x) for x in (start, end))
        if a is not None and b is not None and a > b:
            raise ValueError("the range is reversed")
        if not extend:
            df = self.df
            if a is not None:
                df = df.where(F.col(T) >= a)
            return self.keep(df if b is None else df.where(F.col(T) <= b))
        ends = self.df.groupBy(S).agg(F.min(T).alias("a"), F.max(T).alias("b"))
        lo, hi = F.lit(a).cast("long") if a is not None else F.col("a"), F.lit(b).cast("long") if b is not None else F.col("b")
        grid = ends.select(S, F.explode(F.sequence(lo, hi)).alias(T))
        return self.keep(grid.join(self.df, [S, T], "left"))

    def trim(self, value: float | None = None, leading: bool = True, trailing: bool = True) -> TsFrame:
        """Without missing values (or those equal to `value`) at the ends; a series of nothing else goes."""
        stays = F.col(V).isNotNull() if value is None else (F.col(V) != value) | F.col(V).isNull()
        at = F.when(stays, F.col(T))
        df = self.df.withColumn("__a", F.min(at).over(self.whole())).withColumn("__b", F.max(at).over(self.whole()))
        df = df.where("__a is not null")
        if leading:
            df = df.where(F.col(T) >= F.col("__a"))
        return self.keep(df.where(F.col(T) <= F.col("__b")) if trailing else df)

    def position(self, first: int, last: int | None = None) -> TsFrame:
        """Observations first..last (from 0, last excluded, negative from the end) of each series."""
        at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
        df = self.df.withColumns({"__i": F.row_number().over(self.by_time()) - 1, "__n": F.count(F.lit(1)).over(self.whole())}).where(F.col("__i") >= at(first))
        return self.keep(df if last is None else df.where(F.col("__i") < at(last)))

    def dates(self, selector: str | dt.date) -> TsFrame:
        """Periods named by 'YYYY', 'YYYY-MM', 'YYYY-MM-DD', 'a/b', 'a/', '/b' or a date; ranges are inclusive."""
        if isinstance(selector, dt.date):
            a = b = periods.ordinal(*periods.date_to_year_period(selector, self.freq), self.freq)
        else:
            left, slash, right = selector.partition("/")
            a = self._date_end(left, False) if left else None
            b = self._date_end(right if slash else left, True) if (right or not slash) else None
        if a is not None and b is not None and a > b:
            raise ValueError("the range is reversed")
        return self.project(a, b)

    def __getitem__(self, key) -> TsFrame:
        """x[[y, p]] one period, x[[[y, p], [y, p]]] a range of them, x[i] and x[i:j] positions, x["2000/2001"] or a date, x[mask] where a mask is true."""
        if isinstance(key, TsFrame):
            held = key.df.where(F.col(V)).select(S, T)
            return self.keep(self.df.join(held, [S, T], "left_semi"))
        if isinstance(key, (str, dt.date)):
            return self.dates(key)
        if isinstance(key, slice):
            if key.step not in (None, 1):
                raise ValueError("positions follow each other")
            return self.position(key.start or 0, key.stop)
        if isinstance(key, int) and not isinstance(key, bool):
            return self.position(key, key + 1 if key != -1 else None)
        pairs = [key] if len(key) == 2 and all(isinstance(k, int) for k in key) else list(key)
        if len(pairs) not in (1, 2) or any(len(k) != 2 for k in pairs):
            raise ValueError("a year and period, or the first and last of a range, are needed")
        return self.project(tuple(pairs[0]), tuple(pairs[-1]))

    # ---- single observations

    def at_period(self, year: int, period: int = 1) -> DataFrame:
        """(series, value) at a period; a series that doesn't reach it is an error at run time."""
        at = self.ordinal((year, period))
        found = self.df.groupBy(F.col(S).alias("series")).agg(F.min(T).alias("a"), F.max(T).alias("b"), F.max(F.when(F.col(T) == at, F.col(V))).alias(V))
        inside = F.expr(f"if({at}L < a or {at}L > b, raise_error(concat('series ', series, ' does not reach the period')), true)")
        return found.where(inside).select("series", V)

    def at_date(self, day: dt.date) -> DataFrame:
        """(series, value) of the period that a date lies in."""
        return self.at_period(*periods.date_to_year_period(day, self.freq))

    def between_dates(self, first: dt.date, last: dt.date) -> TsFrame:
        """The periods from the one that holds `first` to the one that holds `last`."""
        return self.project(*(tuple(periods.date_to_year_period(d, self.freq)) for d in (first, last)))

    def period_at(self, position: int) -> DataFrame:
        """(series, t, year, period) of the observation at a position (negative from the end); one outside is an error at run time."""
        ends = self.df.groupBy(F.col(S).alias("series")).agg(F.min(T).alias("a"), F.max(T).alias("b"))
        t = F.col("a") + position if position >= 0 else F.col("b") + (position + 1)
        inside = F.expr("if(t < a or t > b, raise_error(concat('position outside series ', series)), true)")
        found = ends.withColumn("t", t).where(inside)
        return found.select("series", "t", periods.year_of(F.col("t"), self.freq).alias("year"), periods.period_of(F.col("t"), self.freq).alias("period"))

    def _date_end(self, text: str, last: bool) -> int:
        parts = [int(x) for x in text.split("-")]
        y, m = parts[0], parts[1] if len(parts) > 1 else 12 if last else 1
        if len(parts) == 1:
            return periods.ordinal(y, self.freq if last else 1, self.freq)
        d = parts[2] if len(parts) > 2 else periods.year_period_to_date((y, m), 12, last).day
        return periods.ordinal(*periods.date_to_year_period(dt.date(y, m, d), self.freq), self.freq)

    def with_values(self, start: Yp, values: float | list[float | None], end: Yp | None = None, extend: bool = True, series: str | None = None) -> TsFrame:
        """Values from start on replaced (a single one for the whole range to end); with extend beyond the series, gaps missing."""
        a = self.ordinal(start)
        given = list(values) if isinstance(values, (list, tuple)) else [values] * ((self.ordinal(end) if end else a) - a + 1)
        if end is not None and len(given) != self.ordinal(end) - a + 1:
            raise ValueError("as many values as periods are needed")
        spark = self.df.sparkSession
        new = spark.createDataFrame([(a + i, None if v is None or v != v else float(v)) for i, v in enumerate(given)], f"{T} long, __new double").withColumn("__there", F.lit(True))
        names = self.df.select(S).distinct() if series is None else self.df.select(S).where(F.col(S) == series).distinct()
        new = names.join(F.broadcast(new)) if extend else names.join(F.broadcast(new))
        df = self.df.join(new, [S, T], "full" if extend else "left")
        df = df.select(S, T, F.when(F.col("__there"), F.col("__new")).otherwise(F.col(V)).alias(V))
        return self.keep(densify(df) if extend else df)

    def with_items(self, items: dict[Yp, float | None], series: str | None = None) -> TsFrame:
        """The values at the given periods replaced; the series reach out to them, gaps missing."""
        if not items:
            return self
        given = {self.ordinal(k): None if v is None or v != v else float(v) for k, v in items.items()}
        new = self.df.sparkSession.createDataFrame(list(given.items()), f"{T} long, __new double").withColumn("__there", F.lit(True))
        names = self.df.select(S).distinct() if series is None else self.df.select(S).where(F.col(S) == series).distinct()
        df = self.df.join(names.join(F.broadcast(new)), [S, T], "full")
        return self.keep(densify(df.select(S, T, F.when(F.col("__there"), F.col("__new")).otherwise(F.col(V)).alias(V))))

    def assign_range(self, start: Yp, end: Yp, values: float | dict[str, float | list[float | None]]) -> TsFrame:
        """A range of every series (a number) or of the named ones (a dict) replaced, where it lies within them. Unknown names are an error at run time."""
        a, b = self.ordinal(start), self.ordinal(end)
        if a > b:
            raise ValueError("the range is reversed")
        if not isinstance(values, dict):
            return self.keep(self.df.withColumn(V, F.when(F.col(T).between(a, b), F.lit(float(values))).otherwise(F.col(V))))
        rows = []
        for name, v in values.items():
            each = list(v) if isinstance(v, (list, tuple)) else [v] * (b - a + 1)
            if len(each) != b - a + 1:
                raise ValueError(f"{name}: as many values as periods are needed")
            rows += [(name, a + i, None if x is None or x != x else float(x)) for i, x in enumerate(each)]
        new = self.df.sparkSession.createDataFrame(rows, f"{S} string, {T} long, __new double")
        unknown = new.select(S).distinct().join(self.df.select(S).distinct(), S, "left_anti").agg(F.min(S).alias("__unknown"))
        df = self.df.join(F.broadcast(new.withColumn("__there", F.lit(True))), [S, T], "left").join(F.broadcast(unknown))
        df = df.where(F.expr("if(__unknown is not null, raise_error(concat('no series ', __unknown)), true)"))
        return self.keep(df.withColumn(V, F.when(F.col("__there"), F.col("__new")).otherwise(F.col(V))))

    def with_series(self, other: TsFrame) -> TsFrame:
        """The other's series added; they replace those of the same name."""
        return self.combine(other, replace=True)

    def range(self, kind: str = "outer") -> tuple[Yp, Yp] | None:
        """Inclusive range that all series share (inner; None if none) or that any has (outer)."""
        ends = self.df.groupBy(S).agg(F.min(T).alias("a"), F.max(T).alias("b"))
        r = ends.agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.max("a").alias("a"), F.min("b").alias("b")).first()
        lo, hi = (r["lo"], r["hi"]) if kind == "outer" else (r["a"], r["b"])
        return None if lo is None or lo > hi else (periods.year_period(lo, self.freq), periods.year_period(hi, self.freq))

    def ranges(self) -> DataFrame:
        """(start_t, end_t) of the inner and the outer range, as one row."""
        ends = self.df.groupBy(S).agg(F.min(T).alias("a"), F.max(T).alias("b"))
        return ends.agg(F.max("a").alias("inner_start"), F.min("b").alias("inner_end"), F.min("a").alias("outer_start"), F.max("b").alias("outer_end"))

    def align(self, kind: str = "inner") -> TsFrame:
        """All series on the inner or outer range; missing where a series has none."""
        r, ends = self.ranges(), self.df.select(S).distinct()
        grid = ends.join(F.broadcast(r)).where(F.col(f"{kind}_start") <= F.col(f"{kind}_end"))
        grid = grid.select(S, F.explode(F.sequence(F.col(f"{kind}_start"), F.col(f"{kind}_end"))).alias(T))
        return self.keep(grid.join(self.df, [S, T], "left"))

    def select(self, *names: str) -> TsFrame:
        return self.keep(self.df.where(F.col(S).isin(*names)))

    def drop(self, *names: str) -> TsFrame:
        return self.keep(self.df.where(~F.col(S).isin(*names)))

    def rename(self, names: dict[str, str]) -> TsFrame:
        to = reduce(lambda c, kv: c.when(F.col(S) == kv[0], F.lit(kv[1])), names.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.col(S))
        return TsFrame(self.df.withColumn(S, to), self.freq, {names.get(k, k): v for k, v in self.meta.items()})

    def combine(self, other: TsFrame, replace: bool = False) -> TsFrame:
        """Series of both; one of the same name is an error at run time unless the other's replaces it."""
        if other.freq != self.freq:
            raise ValueError("frequencies differ")
        own = self.df.join(other.df.select(S).distinct(), S, "left_anti") if replace else self.df
        df = own.unionByName(other.df)
        if not replace:
            df = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(S, T))).where(F.expr("if(__n > 1, raise_error('a series of that name exists'), true)"))
        return TsFrame(df, self.freq, self.meta | other.meta)

    def map(self, function: Callable, schema: str | None = None) -> TsFrame:
        """Each series through a function of its pandas frame (__series, __t, value); prefer the operations here."""
        return self.keep(self.df.groupBy(S).applyInPandas(function, schema or self.df.schema))

    def info(self) -> DataFrame:
        """Start, end, length and missing values of each series."""
        a, b, f = F.min(T), F.max(T), self.freq
        yp = lambda c, n: (periods.year_of(c, f).alias(f"{n}_year"), periods.period_of(c, f).alias(f"{n}_period"))
        rows = self.df.groupBy(F.col(S).alias("series")).agg(a.alias("a"), b.alias("b"), F.count(F.lit(1)).alias("length"), F.count_if(F.col(V).isNull()).alias("missing"))
        return rows.select("series", F.lit(f).alias("freq"), *yp(F.col("a"), "start"), *yp(F.col("b"), "end"), "length", "missing")

    def tabulate(self, names: list[str], start: Yp | None = None, end: Yp | None = None) -> DataFrame:
        """(t, year, period) and a column for each named series, over their outer range."""
        own = self.project(start, end).df if start or end else self.df
        wide = own.where(F.col(S).isin(names)).groupBy(T).pivot(S, names).agg(F.first(V))
        lo, hi = wide.agg(F.min(T), F.max(T)).first()
        if lo is not None:
            wide = self.df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", T).join(wide, T, "left")
        return wide.select(F.col(T).alias("t"), periods.year_of(F.col(T), self.freq).alias("year"), periods.period_of(F.col(T), self.freq).alias("period"), *[F.col(f"`{n}`") for n in names])

    # ---- time shifts, differences, growth

    def lag(self, n: int = 1) -> TsFrame:
        """The index moves n periods ahead; values stay."""
        return self.keep(self.df.withColumn(T, F.col(T) + n))

    def lead(self, n: int = 1) -> TsFrame:
        return self.lag(-n)

    def _ahead(self, lag: int, order: int = 1) -> None:
        if any(isinstance(x, bool) or not isinstance(x, int) or x < 1 for x in (lag, order)):
            raise ValueError("lag and order must be positive whole numbers")

    def _from(self, n: int, value: Column) -> TsFrame:
        """value, from each series' n-th period (from 0) on."""
        df = self.df.withColumn("__new", value).withColumn("__i", F.row_number().over(self.by_time()))
        return self.drop_meta(df.where(F.col("__i") > n).select(S, T, F.col("__new").alias(V)))

    def delta(self, lag: int = 1, order: int = 1) -> TsFrame:
        """x[t] - x[t-lag], `order` times over."""
        self._ahead(lag, order)
        terms = [F.lag(V, k * lag).over(self.by_time()) if k else F.col(V) for k in range(order + 1)]
        while len(terms) > 1:  # differences of neighbours, so that sums are taken in the order of repeated differencing
            terms = [ieee.sub(a, b) for a, b in zip(terms, terms[1:])]
        return self._from(lag * order, terms[0])

    def delta_log(self, lag: int = 1) -> TsFrame:
        self._ahead(lag)
        return self._from(lag, ieee.sub(ieee.ln(F.col(V)), ieee.ln(F.lag(V, lag).over(self.by_time()))))

    def delta_percent(self, lag: int = 1, annualize: bool = False) -> TsFrame:
        """100 * ((x[t] / x[t-lag]) ** k - 1), k = freq / lag if annualized, else 1."""
        self._ahead(lag)
        if annualize and self.freq % lag:
            raise ValueError("to annualize, lag must divide the frequency")
        ratio = ieee.div(F.col(V), F.lag(V, lag).over(self.by_time()))
        if annualize:
            ratio = ieee.power(ratio, F.lit(float(self.freq // lag)))
        return self._from(lag, ieee.mul(F.lit(100.0), ieee.sub(ratio, F.lit(1.0))))

    # ---- running and moving windows

    def _group(self, mode: str | None) -> list[Column]:
        t, f = F.col(T), self.freq
        if mode is None:
            return []
        if mode in ("year", "yearly"):
            return [periods.year_of(t, f)]
        if mode not in ("month", "monthly"):
            raise ValueError(f"unknown mode: {mode}")
        y, p = periods.year_of(t, f), periods.period_of(t, f)
        if f <= 36:
            return [y, F.least(F.lit(12), F.floor((p * 12 - 1) / f) + 1)]
        days = F.when(periods.leap(y), F.lit(366)).otherwise(F.lit(365))
        day = F.least(days, F.floor((p * days + f - 1) / f)).cast("int")
        return [y, F.month(F.date_add(F.make_date(y, F.lit(1), F.lit(1)), day - 1))]

    def _running(self, total: Column, groups: list[Column], skip: bool, start: Yp | None, end: Yp | None) -> TsFrame:
        own = self.project(start, end) if start or end else self
        df = own.df.withColumns({f"__g{i}": g for i, g in enumerate(groups)})
        w = W.partitionBy(S, *[f"__g{i}" for i in range(len(groups))]).orderBy(T).rowsBetween(W.unboundedPreceding, 0)
        value = total.over(w)
        if not skip:
            value = F.when(F.count(V).over(w) == F.count(F.lit(1)).over(w), value)
        return self.keep(df.withColumn(V, value))

    def cumulative_sum(self, mode: str | None = None, skip_missing: bool = False, start: Yp | None = None, end: Yp | None = None) -> TsFrame:
        """Running sum, anew in each calendar year or month by mode; a missing value makes the rest of the group missing unless skipped."""
        return self._running(F.sum(V), self._group(mode), skip_missing, start, end)

    def cumulative_product(self, skip_missing: bool = False, start: Yp | None = None, end: Yp | None = None) -> TsFrame:
        return self._running(F.product(V), [], skip_missing, start, end)

    def _moving(self, total: Column, window: int, direction: str, skip: bool) -> TsFrame:
        if isinstance(window, bool) or window < 1:
            raise ValueError("the window must be a positive whole number")
        back = {"back": 0, "center": window - 1 - window // 2, "ahead": window - 1}
        if direction not in back:
            raise ValueError(f"unknown direction: {direction}")
        w = self.by_time().rowsBetween(1 - window, 0)
        value = total.over(w) if skip else F.when(F.count(V).over(w) == window, total.over(w))
        return self.keep(self._from(window - 1, value).df.withColumn(T, F.col(T) - back[direction]))

    def moving_average(self, window: int, direction: str = "back", skip_missing: bool = False) -> TsFrame:
        return self._moving(F.avg(V), window, direction, skip_missing)

    def moving_sum(self, window: int, direction: str = "back", skip_missing: bool = False) -> TsFrame:
        return self._moving(F.sum(V), window, direction, skip_missing)

    # ---- levels

    def index_number(self, base_year: int) -> TsFrame:
        """Values with the base year's mean as 100; absent, missing or zero bases are errors at run time."""
        base = periods.year_of(F.col(T), self.freq) == base_year
        w = self.whole()
        n, known, mean = F.count_if(base).over(w), F.count(F.when(base, F.col(V))).over(w), F.avg(F.when(base, F.col(V))).over(w)
        df = self.df.withColumns({"__n": n, "__k": known, "__m": mean})
        value = F.expr("""case when __n = 0 then cast(raise_error('the base year is absent') as double)
            when __k < __n then cast(raise_error('the base year has missing values') as double)
            when __m = 0 then cast(raise_error('the base year has mean 0') as double) else value * (100D / __m) end""")
        return self.keep(df.withColumn(V, value))

    def magnitude(self) -> DataFrame:
        """(series, magnitude): root of the sum of squares of what is not missing."""
        return self.df.groupBy(F.col(S).alias("series")).agg(F.sqrt(F.coalesce(F.sum(F.col(V) * F.col(V)), F.lit(0.0))).alias("magnitude"))

    def verify_magnitude(self, threshold: float = 1e-6) -> DataFrame:
        return self.magnitude().where(F.col("magnitude") > threshold)

    EDGE = 8

    def extend(self, back_to: Yp | None = None, up_to: Yp | None = None, mode: str = "growth", factor: float | None = None) -> TsFrame:
        """Series extrapolated to back_to and up_to, never shrunk.

        Modes missing, zero, constant, mean4, growth, growth4, linear, quadratic, myconst, myrate. zero fills every missing value; the others
        start at the first or last value there is and overwrite missing ones beyond it on an extended side; an edge that is too
        short or has gaps gives missing values.
        """
        if mode not in ("missing", "zero", "constant", "mean4", "growth", "growth4", "linear", "quadratic", "myconst", "myrate"):
            raise ValueError(f"unknown mode: {mode}")
        if mode in ("myconst", "myrate") and factor is None:
            raise ValueError(f"{mode} needs a factor")
        known = F.when(F.col(V).isNotNull(), F.col(T))
        df = self.df.withColumns({"__a": F.min(known).over(self.whole()), "__b": F.max(known).over(self.whole())})
        n = self.EDGE
        edge = lambda k, side: F.max(F.when(F.col(T) == (F.col("__a") + k if side == "a" else F.col("__b") - k), F.col(V))).alias(f"{side}{k}")
        facts = df.groupBy(S).agg(F.min(T).alias("lo"), F.max(T).alias("hi"), F.first("__a").alias("a"), F.first("__b").alias("b"), *[edge(k, s) for s in "ab" for k in range(n)])
        low = F.least(F.col("lo"), F.lit(self.ordinal(back_to)).cast("long")) if back_to else F.col("lo")
        high = F.greatest(F.col("hi"), F.lit(self.ordinal(up_to)).cast("long")) if up_to else F.col("hi")
        facts = facts.withColumns({"new_lo": low, "new_hi": high, **self._rates(mode)})  # rates once a series, not once a period
        grid = facts.withColumn(T, F.explode(F.sequence("new_lo", "new_hi"))).join(self.df, [S, T], "left")
        value = F.col(V)
        if mode == "zero":
            return self.drop_meta(grid.withColumn(V, F.coalesce(value, F.lit(0.0))))
        if mode != "missing":
            before = (F.col("new_lo") < F.col("lo")) & (F.col(T) < F.col("a"))
            after = (F.col("new_hi") > F.col("hi")) & (F.col(T) > F.col("b"))
            value = F.when(before, self._edge_value(mode, "a", F.col("a") - F.col(T), factor)).when(after, self._edge_value(mode, "b", F.col(T) - F.col("b"), factor)).otherwise(value)
        return self.drop_meta(grid.withColumn(V, value))

    @staticmethod
    def _rates(mode: str) -> dict[str, Column]:
        """Growth a period at each edge, as columns of the one row a series."""
        out = {}
        for side in "ab":
            e = [F.col(f"{side}{k}") for k in range(TsFrame.EDGE)]
            if mode == "growth":
                out[f"rate_{side}"] = ieee.div(e[0], e[1])
            elif mode == "growth4":
                out[f"rate_{side}"] = ieee.power(ieee.div(e[0] + e[1] + e[2] + e[3], e[4] + e[5] + e[6] + e[7]), F.lit(0.25))
        return out

    @staticmethod
    def _edge_value(mode: str, side: str, d: Column, factor: float | None) -> Column:
        e = [F.col(f"{side}{k}") for k in range(TsFrame.EDGE)]
        d = d.cast("double")
        if mode == "constant":
            return e[0]
        if mode == "myconst":
            return F.lit(float(factor))
        if mode == "myrate":
            return ieee.mul(e[0], ieee.power(F.lit(float(factor)), d))
        if mode == "mean4":
            return (e[0] + e[1] + e[2] + e[3]) / 4
        if mode in ("growth", "growth4"):
            return ieee.mul(e[0], ieee.power(F.col(f"rate_{side}"), d))
        if mode == "linear":
            return e[0] + d * (e[0] - e[1])
        second, slope = (e[0] - 2 * e[1] + e[2]) / 2, (3 * e[0] - 4 * e[1] + e[2]) / 2
        return e[0] + (slope + second * d) * d

    # ---- several series into one

    @staticmethod
    def merge(frames: list[TsFrame], method: str | None = None, skip_missing: bool = True, name: str = "merged") -> TsFrame:
        """One series over the union of ranges: the first value in order of the frames, or their sum, average, max or min."""
        if len({f.freq for f in frames}) != 1:
            raise ValueError("frequencies differ")
        if method not in (None, "sum", "average", "ave", "max", "min"):
            raise ValueError(f"unknown method: {method}")
        rows = reduce(DataFrame.unionByName, [f.df.select(T, V).withColumn("__k", F.lit(k)) for k, f in enumerate(frames)])
        known, k = F.col(V).isNotNull(), len(frames)
        if method is None:
            if skip_missing:
                value = F.min_by(V, F.when(known, F.col("__k")))
            else:  # stops at the first frame in order that doesn't cover the period
                value = F.expr(FIRST_UNBROKEN)
        else:
            total = {"sum": F.sum(V), "average": F.avg(V), "ave": F.avg(V), "max": F.max(V), "min": F.min(V)}[method]
            value = total if skip_missing else F.when(F.count(V) == k, total)
        df = rows.groupBy(T).agg(value.alias(V)).withColumn(S, F.lit(name))
        return TsFrame(densify(df.select(S, T, V)), frames[0].freq)

    def join(self, second: TsFrame, join_period: Yp | None = None, allow_gap: bool = False, name: str = "joined") -> TsFrame:
        """This series before the switch, the second from it on (its start unless given); a gap is an error unless allowed."""
        if second.freq != self.freq:
            raise ValueError("frequencies differ")
        ends = second.df.agg(F.min(T).alias("a"), F.max(T).alias("b"), F.lit(1).alias("one"))
        at = F.col("a") if join_period is None else F.lit(self.ordinal(join_period)).cast("long")
        inside = F.expr("if(__at < a or __at > b, raise_error('the switch must lie inside the second series'), true)")
        first = self.df.join(F.broadcast(ends.withColumn("__at", at).where(inside))).where(F.col(T) < F.col("__at")).select(T, V)
        rest = second.df.join(F.broadcast(ends.withColumn("__at", at).where(inside))).where(F.col(T) >= F.col("__at")).select(T, V)
        both = first.unionByName(rest).withColumn(S, F.lit(name)).select(S, T, V)
        if not allow_gap:
            gap = F.col(T) - F.lag(T).over(self.by_time())
            both = both.withColumn("__gap", gap).where(F.expr("if(__gap > 1, raise_error('there is a gap between the series'), true)")).drop("__gap")
        return TsFrame(densify(both), self.freq)

    # ---- arithmetic, comparison, logic

    def _with(self, other: TsFrame | float, function: Callable[[Column, Column], Column], name: str | None = None, swap: bool = False) -> TsFrame:
        if not isinstance(other, TsFrame):
            a, b = F.col(V), F.lit(other)
            return self.drop_meta(self.df.withColumn(V, function(b, a) if swap else function(a, b)))
        if other.freq != self.freq:
            raise ValueError("frequencies differ")
        right = other.df.withColumnRenamed(V, "__right")
        if name is None:
            df = self.df.join(right, [S, T])
        else:
            ends = lambda d, k: d.agg(F.min(T).alias(f"a{k}"), F.max(T).alias(f"b{k}"), (F.min(S) < F.max(S)).alias(f"m{k}"))  # noqa: E731  one row
            guard = ends(self.df, 1).join(ends(other.df, 2))
            fits = F.expr("""if(coalesce(m1, false) or coalesce(m2, false), raise_error('operands of a named result are single series'),
                if(greatest(a1, a2) > least(b1, b2), raise_error('the series have no period in common'), true))""")
            checked = guard.where(fits).select(F.lit(True).alias("__fits"))
            df = self.df.drop(S).join(right.drop(S), T).join(F.broadcast(checked), F.lit(True), "right").where(F.col(T).isNotNull()).withColumn(S, F.lit(name))
        return self.drop_meta(df.withColumn(V, function(F.col(V), F.col("__right"))))

    def combine_values(self, other: TsFrame, function: Callable[[Column, Column], Column], name: str = "result") -> TsFrame:
        """function(a, b) of two single series, whatever their names, on the periods both have."""
        return self._with(other, function, name)

    def __add__(self, o):
        return self._with(o, ieee.add)

    __radd__ = __add__

    def __sub__(self, o):
        return self._with(o, ieee.sub)

    def __rsub__(self, o):
        return self._with(o, ieee.sub, swap=True)

    def __mul__(self, o):
        return self._with(o, ieee.mul)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._with(o, ieee.div)

    def __rtruediv__(self, o):
        return self._with(o, ieee.div, swap=True)

    def __floordiv__(self, o):
        return self._with(o, ieee.floordiv)

    def __mod__(self, o):
        return self._with(o, ieee.mod)

    def __pow__(self, o):
        return self._with(o, ieee.power)

    def __neg__(self):
        return self.drop_meta(self.df.withColumn(V, -F.col(V)))

    def __pos__(self):
        return self

    def __abs__(self):
        return self.drop_meta(self.df.withColumn(V, F.abs(V)))

    def log(self):
        return self.keep(self.df.withColumn(V, ieee.ln(F.col(V))))

    def exp(self):
        return self.keep(self.df.withColumn(V, ieee.exp(F.col(V))))

    def _number(self, o):
        if isinstance(o, bool):
            raise TypeError("a series is compared with numbers or series")
        return o

    def __lt__(self, o):
        return self._with(self._number(o), lambda a, b: a < b)

    def __le__(self, o):
        return self._with(self._number(o), lambda a, b: a <= b)

    def __gt__(self, o):
        return self._with(self._number(o), lambda a, b: a > b)

    def __ge__(self, o):
        return self._with(self._number(o), lambda a, b: a >= b)

    def equal(self, o):
        return self._with(self._number(o), lambda a, b: a == b)

    def differs(self, o):
        return self._with(self._number(o), lambda a, b: a != b)

    def __and__(self, o):
        return self._with(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._with(o, lambda a, b: a | b)

    def __xor__(self, o):
        return self._with(o, lambda a, b: a != b)

    def __invert__(self):
        return self.drop_meta(self.df.withColumn(V, ~F.col(V)))

    def any(self, skip_missing: bool = True) -> DataFrame:
        """(series, result) of a mask; unless missing values are skipped they may leave it undetermined."""
        some, gap = F.bool_or(V), F.count_if(F.col(V).isNull()) > 0
        value = F.coalesce(some, F.lit(False)) if skip_missing else F.when(some, True).when(gap, None).otherwise(False)
        return self.df.groupBy(F.col(S).alias("series")).agg(value.alias("result"))

    def all(self, skip_missing: bool = True) -> DataFrame:
        every, gap = F.bool_and(V), F.count_if(F.col(V).isNull()) > 0
        value = F.coalesce(every, F.lit(True)) if skip_missing else F.when(~every, False).when(gap, None).otherwise(True)
        return self.df.groupBy(F.col(S).alias("series")).agg(value.alias("result"))

    # ---- calendar and output

    def to_frequency(self, freq: int | str, method: str | None = None) -> TsFrame:
        from .resample import convert

        return convert(self, freq, method)

    def with_dates(self, last: bool = True, pattern: str | None = None) -> DataFrame:
        """(series, t, date) of each period; with a strftime pattern (and %q, the quarter) the text instead."""
        d = periods.t_to_date(F.col(T), self.freq, last)
        if pattern:
            parts = pattern.split("%q")
            pieces: list[Column] = []
            for i, p in enumerate(parts):
                pieces += [F.quarter(d).cast("string")] if i else []
                pieces += [F.date_format(d, periods.java_pattern(p))] if p else []
            d = F.concat(*pieces)
        return self.df.select(F.col(S).alias("series"), F.col(T).alias("t"), d.alias("date"))

    def year_periods(self) -> DataFrame:
        return self.df.select(F.col(S).alias("series"), F.col(T).alias("t"), periods.year_of(F.col(T), self.freq).alias("year"), periods.period_of(F.col(T), self.freq).alias("period"))

    def rows(self) -> DataFrame:
        """(series, t, value): the frame under public names."""
        return self.df.select(F.col(S).alias("series"), F.col(T).alias("t"), V)

    def values(self) -> list[float | None]:
        """Values of a single series in order, on the driver."""
        return [r[V] for r in self.df.orderBy(T).collect()]

    def wide(self, names: list[str]) -> DataFrame:
        """(__t, and a column for each named series)."""
        return self.df.where(F.col(S).isin(names)).groupBy(T).pivot(S, names).agg(F.first(V))


def densify(df: DataFrame) -> DataFrame:
    """Rows (__series, __t, value) with a row for each period between a series' first and last: each row fills the gap after it."""
    after = F.lead(T).over(W.partitionBy(S).orderBy(T))
    gaps = df.withColumn("__to", F.coalesce(after - 1, F.col(T))).select(S, F.col(T).alias("__from"), F.explode(F.sequence(F.col(T), F.col("__to"))).alias(T), V)
    return gaps.select(S, T, F.when(F.col(T) == F.col("__from"), F.col(V)).alias(V))
