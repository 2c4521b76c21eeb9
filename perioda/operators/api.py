"""Functional names of the series operations, with the short and upper-case aliases that users of such toolkits expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import periods
from .frame import TsFrame
from .resample import convert


def timeseries(spark: SparkSession, values, *, start=(2000, 1), freq=1, name="x", source=None, title=None, units=None, scale_factor=0) -> TsFrame:
    return TsFrame.of(spark, values, start, freq, name, source=source, title=title, units=units, scale_factor=scale_factor)


def tslag(x: TsFrame, n: int = 1) -> TsFrame:
    return x.lag(n)


def tslead(x: TsFrame, n: int = 1) -> TsFrame:
    return x.lead(n)


def tsdelta(x: TsFrame, lag: int = 1, order: int = 1) -> TsFrame:
    return x.delta(lag, order)


def tsdeltalog(x: TsFrame, lag: int = 1) -> TsFrame:
    return x.delta_log(lag)


def tsdeltap(x: TsFrame, lag: int = 1, annualize: bool = False) -> TsFrame:
    return x.delta_percent(lag, annualize)


def tsproject(x: TsFrame, start=None, end=None, extend: bool = False) -> TsFrame:
    return x.project(start, end, extend)


def tstrim(x: TsFrame, value=None, leading: bool = True, trailing: bool = True) -> TsFrame:
    return x.trim(value, leading, trailing)


def cumsum(x: TsFrame, mode=None, skip_missing: bool = False, start=None, end=None) -> TsFrame:
    return x.cumulative_sum(mode, skip_missing, start, end)


def cumprod(x: TsFrame, skip_missing: bool = False, start=None, end=None) -> TsFrame:
    return x.cumulative_product(skip_missing, start, end)


def movavg(x: TsFrame, window: int, direction: str = "back", skip_missing: bool = False) -> TsFrame:
    return x.moving_average(window, direction, skip_missing)


def movtot(x: TsFrame, window: int, direction: str = "back", skip_missing: bool = False) -> TsFrame:
    return x.moving_sum(window, direction, skip_missing)


def indexnum(x: TsFrame, base_year: int) -> TsFrame:
    return x.index_number(base_year)


def tsmerge(*frames: TsFrame, method=None, skip_missing: bool = True) -> TsFrame:
    return TsFrame.merge(list(frames), method, skip_missing)


def tsjoin(first: TsFrame, second: TsFrame, join_period=None, allow_gap: bool = False) -> TsFrame:
    return first.join(second, join_period, allow_gap)


def tsextend(x: TsFrame, back_to=None, up_to=None, mode: str = "growth", factor=None) -> TsFrame:
    return x.extend(back_to, up_to, mode, factor)


def annual(x: TsFrame, method=None) -> TsFrame:
    return convert(x, 1, method, strict=True)


def semiannual(x: TsFrame, method=None) -> TsFrame:
    return convert(x, 2, method, strict=True)


def quarterly(x: TsFrame, method=None) -> TsFrame:
    return convert(x, 4, method, strict=True)


def monthly(x: TsFrame, method=None) -> TsFrame:
    return convert(x, 12, method, strict=True)


def daily(x: TsFrame, method=None) -> TsFrame:
    return convert(x, 366, method, strict=True)


def get_range(x: TsFrame, kind: str = "inner"):
    return x.range(kind)


def series_info(x: TsFrame) -> DataFrame:
    return x.info()


def tsinfo(x: TsFrame, mode: str):
    """One fact of a single series: FREQ, STARTY, STARTP, ENDY, ENDP, START (or START2, a pair), END (END2); START and END are year + period / freq."""
    r = x.info().first()
    a, b = (r["start_year"], r["start_period"]), (r["end_year"], r["end_period"])
    return {"FREQ": r["freq"], "STARTY": a[0], "STARTP": a[1], "ENDY": b[0], "ENDP": b[1], "START": a[0] + a[1] / r["freq"], "END": b[0] + b[1] / r["freq"], "START2": a, "END2": b, "LENGTH": r["length"]}[mode.upper()]


def tabulate(x: TsFrame, names: list[str], start=None, end=None) -> DataFrame:
    return x.tabulate(names, start, end)


def magnitude(x: TsFrame) -> DataFrame:
    return x.magnitude()


def verify_magnitude(x: TsFrame, threshold: float = 1e-6) -> DataFrame:
    return x.verify_magnitude(threshold)


def get_dates(x: TsFrame, last: bool = True, format=None) -> DataFrame:  # noqa: A002
    return x.with_dates(last, format)


def get_year_periods(x: TsFrame) -> DataFrame:
    return x.year_periods()


def is_series(x) -> bool:
    return isinstance(x, TsFrame)


def display(x: TsFrame, digits: int = 7) -> str:
    """Text of a single series: a grid of years by periods for quarterly and monthly ones, else a line for each period."""
    rows = [(r["__t"], r["value"]) for r in x.df.orderBy("__t").collect()]
    show = lambda v: "NA" if v is None else format(v, f".{digits}g")
    if x.freq not in (4, 12):
        return "\n".join(f"{y}-{p}: {show(v)}" for t, v in rows for y, p in [periods.year_period(t, x.freq)])
    heads = [f"Q{i}" for i in range(1, 5)] if x.freq == 4 else "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    cells = dict(rows)
    lines = [["", *heads]]
    for y in range(rows[0][0] // x.freq, rows[-1][0] // x.freq + 1):
        lines.append([str(y), *[show(cells[t]) if (t := y * x.freq + i) in cells else "" for i in range(x.freq)]])
    width = [max(len(r[i]) for r in lines) for i in range(x.freq + 1)]
    return "\n".join(" ".join(c.rjust(w) for c, w in zip(r, width)).rstrip() for r in lines)


date_to_year_period, year_period_to_date = periods.date_to_year_period, periods.year_period_to_date
normalize_year_period, num_periods = periods.normalize_year_period, periods.num_periods
date2yp, normalizeYP, NUMPERIOD = date_to_year_period, normalize_year_period, num_periods
TIMESERIES = TSERIES = timeseries
TSLAG, TSLEAD = tslag, tslead
TSDELTA = DELTA = tsdelta
TSDELTALOG = tsdeltalog
TSDELTAP = DELTAP = tsdeltap
TSPROJECT, TSTRIM = tsproject, tstrim
CUMSUM = CUMULO = cumsum
CUMPROD = cumprod
MOVAVG = MAVE = movavg
MOVTOT = MOVSUM = MTOT = MSUM = movtot
INDEXNUM, TSMERGE, TSJOIN = indexnum, tsmerge, tsjoin
TSEXTEND = EXTEND = tsextend
ANNUAL = YEARLY = annual
SEMIANNUAL, QUARTERLY, MONTHLY, DAILY = semiannual, quarterly, monthly, daily
GETRANGE, TSLOOK, TSINFO, TABIT, VERIFY_MAGNITUDE = get_range, series_info, tsinfo, tabulate, verify_magnitude
GETDATE = get_dates
GETYEARPERIOD = TSDATES = get_year_periods
convert_frequency = convert
