"""Registered queries of the series operations over the shared tables, each with its SQL.

Base series: om (orders, monthly value by priority), lm (line items, monthly value by return flag), ed (events, daily mean by type). Sums are
taken in decimals, so they don't depend on the order of rows.
"""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..operators.frame import T, TsFrame, V
from ..operators.resample import convert
from ..sources import exchange

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def total(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def om(spark: SparkSession, sf: str) -> TsFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderpriority").alias("series"), periods.date_to_t(F.col("o_orderdate"), 12).alias("t"))
    return TsFrame.from_rows(rows.agg(total("o_totalprice").alias("value")), 12)


def lm(spark: SparkSession, sf: str) -> TsFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("series"), periods.date_to_t(F.col("l_shipdate"), 12).alias("t"))
    return TsFrame.from_rows(rows.agg(total("l_extendedprice").alias("value")), 12)


def ed(spark: SparkSession, sf: str) -> TsFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("series"), periods.date_to_t(F.col("ts"), 366).alias("t"))
    return TsFrame.from_rows(rows.agg((total("value") / F.count("value")).alias("value")), 366)


def single(x: TsFrame, name: str) -> TsFrame:
    return x.select(name)


def _base_sql(name: str, table: str, series: str, t: str, value: str) -> str:
    return f"""{name}_raw AS (SELECT {series} AS series, CAST({t} AS BIGINT) AS t, {value} AS value FROM {table} GROUP BY 1, 2),
    {name}_ends AS (SELECT series, min(t) AS a, max(t) AS b FROM {name}_raw GROUP BY 1),
    {name}_grid AS (SELECT series, unnest(generate_series(a, b)) AS t FROM {name}_ends),
    {name} AS (SELECT g.series, g.t, r.value FROM {name}_grid g LEFT JOIN {name}_raw r ON g.series = r.series AND g.t = r.t)"""


SQL = {
    "om": _base_sql("om", "orders", "o_orderpriority", "year(o_orderdate) * 12 + month(o_orderdate) - 1", "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"),
    "lm": _base_sql("lm", "lineitem", "l_returnflag", "year(l_shipdate) * 12 + month(l_shipdate) - 1", "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"),
    "ed": _base_sql("ed", "events", "event_type", "year(ts) * 366 + dayofyear(ts) - 1", "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value)"),
}
ONE = {  # single series under one name
    "x": "x AS (SELECT t, value FROM om WHERE series = '1-URGENT')",
    "y": "y AS (SELECT t, value FROM lm WHERE series = 'N')",
}
PRIORITY, FLAG = "1-URGENT", "N"


def rounded(x: TsFrame | DataFrame, digits: int = 4) -> DataFrame:
    df = x.rows() if isinstance(x, TsFrame) else x
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


def ask(name: str, base: tuple[str, ...] | str, function: Callable[..., TsFrame | DataFrame], select: str, digits: int = 4) -> None:
    """Register a query over base series and its SQL, a SELECT over tables of the same names."""
    base = (base,) if isinstance(base, str) else base
    makers = {"om": om, "lm": lm, "ed": ed, "x": lambda s, d: single(om(s, d), PRIORITY), "y": lambda s, d: single(lm(s, d), FLAG)}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(function(*[makers[b](spark, sf) for b in base]), digits)

    QUERIES[name] = run
    if select:
        needed = list(dict.fromkeys({"x": "om", "y": "lm"}.get(b, b) for b in base))
        parts = [SQL[b] for b in needed] + [ONE[b] for b in base if b in ONE]
        ORACLE[name] = f"WITH {', '.join(parts)} {select}"


def rows_sql(value: str, source: str = "om", where: str = "", t: str = "t", digits: int = 4) -> str:
    return f"SELECT series, {t} AS t, round({value}, {digits}) AS value FROM {source} {where}"


W_ = "OVER (PARTITION BY series ORDER BY t)"
ask("ts_base_monthly", "om", lambda x: x, rows_sql("value"))
ask("ts_base_daily", "ed", lambda x: x, rows_sql("value", "ed", digits=7), 7)
ask("ts_lag", "om", lambda x: x.lag(3), rows_sql("value", t="t + 3"))
ask("ts_lead", "om", lambda x: x.lead(2), rows_sql("value", t="t - 2"))


def _window(cols: str, source: str = "om") -> str:
    return f"(SELECT *, row_number() {W_} AS rn, {cols} FROM {source})"


ask("ts_delta", "om", lambda x: x.delta(), rows_sql("value - p1", _window(f"lag(value, 1) {W_} AS p1"), "WHERE rn > 1"))
ask("ts_delta_order2", "om", lambda x: x.delta(1, 2), rows_sql("(value - p1) - (p1 - p2)", _window(f"lag(value, 1) {W_} AS p1, lag(value, 2) {W_} AS p2"), "WHERE rn > 2"))
ask("ts_delta_lag12", "om", lambda x: x.delta(12), rows_sql("value - p1", _window(f"lag(value, 12) {W_} AS p1"), "WHERE rn > 12"))
ask("ts_deltalog", "om", lambda x: x.delta_log(), rows_sql("ln(value) - ln(p1)", _window(f"lag(value, 1) {W_} AS p1"), "WHERE rn > 1", digits=6), 6)
ask("ts_deltap", "om", lambda x: x.delta_percent(), rows_sql("100 * (value / p1 - 1)", _window(f"lag(value, 1) {W_} AS p1"), "WHERE rn > 1", digits=6), 6)
ask("ts_deltap_annualized", "om", lambda x: x.delta_percent(6, True), rows_sql("100 * (pow(value / p1, 2) - 1)", _window(f"lag(value, 6) {W_} AS p1"), "WHERE rn > 6", digits=6), 6)
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _running(total_: str, groups: str, source: str = "om", strict: bool = True) -> str:
    w = f"OVER (PARTITION BY series{groups} ORDER BY t {RUN})"
    value = f"{total_} {w}"
    return rows_sql(f"CASE WHEN count(value) {w} = count(*) {w} THEN {value} END" if strict else value, source)


ask("ts_cumsum", "om", lambda x: x.cumulative_sum(), _running("sum(value)", ""))
ask("ts_cumsum_yearly", "om", lambda x: x.cumulative_sum("yearly"), _running("sum(value)", ", t // 12"))
ask("ts_cumsum_monthly", "ed", lambda x: x.cumulative_sum("monthly"), _running("sum(value)", ", t // 366, month(make_date(CAST(t // 366 AS INT), 1, 1) + CAST(least(t % 366, CASE WHEN (t // 366) % 4 = 0 THEN 365 ELSE 364 END) AS INT))", "ed"))
ask("ts_cumsum_skip", "om", lambda x: x.with_values((1996, 5), None).cumulative_sum(skip_missing=True), _running("sum(value)", "", f"(SELECT series, t, CASE WHEN t <> {1996 * 12 + 4} THEN value END AS value FROM om)", False))
ask("ts_cumprod", "om", lambda x: x.keep(x.df.withColumn(V, F.lit(1.01))).cumulative_product(), rows_sql(f"pow(1.01, row_number() {W_})", digits=6), 6)


def _moving(total_: str, n: int, shift: int, strict: bool = True, source: str = "om") -> str:
    w = f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = f"CASE WHEN count(value) {w} = {n} THEN {total_} {w} END" if strict else f"{total_} {w}"
    return rows_sql("m", f"(SELECT series, t - {shift} AS t, {value} AS m, row_number() {W_} AS rn FROM {source})", f"WHERE rn >= {n}")


ask("ts_movavg_back", "om", lambda x: x.moving_average(3), _moving("avg(value)", 3, 0))
ask("ts_movavg_center", "om", lambda x: x.moving_average(4, "center"), _moving("avg(value)", 4, 1))
ask("ts_movavg_ahead", "om", lambda x: x.moving_average(3, "ahead"), _moving("avg(value)", 3, 2))
ask("ts_movtot", "om", lambda x: x.moving_sum(12), _moving("sum(value)", 12, 0))
HOLE = f"(SELECT series, t, CASE WHEN t % 5 <> 0 THEN value END AS value FROM om)"  # noqa: F541


def holed(x: TsFrame) -> TsFrame:
    return x.keep(x.df.withColumn(V, F.when(F.col(T) % 5 != 0, F.col(V))))


ask("ts_movavg_skip", "om", lambda x: holed(x).moving_average(3, skip_missing=True), _moving("avg(value)", 3, 0, False, HOLE))
ask("ts_indexnum", "om", lambda x: x.keep(x.df.fillna({V: 0.0})).index_number(1996), rows_sql("coalesce(value, 0) * 100 / avg(CASE WHEN t // 12 = 1996 THEN coalesce(value, 0) END) OVER (PARTITION BY series)"))
ask("ts_project_clip", "om", lambda x: x.project((1996, 3), (1997, 2)), rows_sql("value", where=f"WHERE t BETWEEN {1996 * 12 + 2} AND {1997 * 12 + 1}"))
ask("ts_project_extend", "om", lambda x: x.project((1994, 10), (1995, 6), True), f"SELECT s.series, g.t, round(om.value, 4) AS value FROM (SELECT DISTINCT series FROM om) s CROSS JOIN (SELECT unnest(generate_series({1994 * 12 + 9}, {1995 * 12 + 5})) AS t) g LEFT JOIN om ON om.series = s.series AND om.t = g.t")
ask("ts_date_selector", "om", lambda x: x.dates("1996-02/1996-07"), rows_sql("value", where=f"WHERE t BETWEEN {1996 * 12 + 1} AND {1996 * 12 + 6}"))
ask("ts_positions", "om", lambda x: x.position(2, -2), rows_sql("value", f"(SELECT *, row_number() {W_} AS rn, count(*) OVER (PARTITION BY series) AS n FROM om)", "WHERE rn > 2 AND rn <= n - 2"))
EDGES = f"(SELECT series, t, CASE WHEN t >= {1995 * 12 + 3} THEN value END AS value FROM om)"


def late(x: TsFrame) -> TsFrame:
    return x.keep(x.df.withColumn(V, F.when(F.col(T) >= 1995 * 12 + 3, F.col(V))))


ask("ts_trim", "om", lambda x: late(x).trim(), rows_sql("value", f"(SELECT *, min(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series) AS a, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series) AS b FROM {EDGES})", "WHERE t BETWEEN a AND b"))
ask("ts_trim_leading_value", "om", lambda x: late(x).keep(late(x).df.fillna({V: 0.0})).trim(0.0, trailing=False), rows_sql("value", f"(SELECT *, min(CASE WHEN value <> 0 THEN t END) OVER (PARTITION BY series) AS a FROM (SELECT series, t, coalesce(value, 0) AS value FROM {EDGES}))", "WHERE t >= a"))
ask("ts_at_period", "om", lambda x: x.at_period(1997, 5), f"SELECT series, round(value, 4) AS value FROM om WHERE t = {1997 * 12 + 4}")
ask("ts_at_date", "om", lambda x: x.at_date(dt.date(1998, 7, 9)), f"SELECT series, round(value, 4) AS value FROM om WHERE t = {1998 * 12 + 6}")
ask("ts_between_dates", "om", lambda x: x.between_dates(dt.date(1997, 2, 28), dt.date(1998, 1, 1)), rows_sql("value", where=f"WHERE t BETWEEN {1997 * 12 + 1} AND {1998 * 12}"))
ask("ts_period_at", "om", lambda x: x.period_at(-2), "SELECT series, t, CAST(t // 12 AS INT) AS year, CAST(t % 12 + 1 AS INT) AS period FROM (SELECT series, max(t) - 1 AS t FROM om GROUP BY 1)")
ask("ts_getitem_range", "om", lambda x: x[[[1996, 3], [1996, 8]]], rows_sql("value", where=f"WHERE t BETWEEN {1996 * 12 + 2} AND {1996 * 12 + 7}"))
ask("ts_getitem_mask", "om", lambda x: x[x > 1e6], rows_sql("value", where="WHERE value > 1e6"))
ask("ts_with_items", "om", lambda x: x.with_items({(1997, 1): 1.0, (1997, 6): None}), rows_sql(f"CASE t WHEN {1997 * 12} THEN 1.0 WHEN {1997 * 12 + 5} THEN NULL ELSE value END"))
ask("ts_assign_range_named", "om", lambda x: x.assign_range((1996, 1), (1996, 3), {"1-URGENT": 7.0, "5-LOW": [1.0, None, 3.0]}), rows_sql(f"CASE WHEN series = '1-URGENT' AND t BETWEEN {1996 * 12} AND {1996 * 12 + 2} THEN 7.0 WHEN series = '5-LOW' AND t BETWEEN {1996 * 12} AND {1996 * 12 + 2} THEN CASE t WHEN {1996 * 12} THEN 1.0 WHEN {1996 * 12 + 2} THEN 3.0 END ELSE value END"))
ask("ts_with_series", ("om", "lm"), lambda a, b: a.with_series(b.rename({"N": "1-URGENT"})), "SELECT series, t, round(value, 4) AS value FROM (SELECT * FROM om WHERE series <> '1-URGENT' UNION ALL SELECT CASE series WHEN 'N' THEN '1-URGENT' ELSE series END, t, value FROM lm)")
ask("ts_with_values", "om", lambda x: x.with_values((1996, 1), [1.0, 2.0, None]), rows_sql(f"CASE t WHEN {1996 * 12} THEN 1.0 WHEN {1996 * 12 + 1} THEN 2.0 WHEN {1996 * 12 + 2} THEN NULL ELSE value END"))
ask("ts_assign_range", "om", lambda x: x.with_values((1996, 1), 7.0, (1996, 12), series=PRIORITY), rows_sql(f"CASE WHEN series = '1-URGENT' AND t BETWEEN {1996 * 12} AND {1996 * 12 + 11} THEN 7.0 ELSE value END"))
ask("ts_select_rename", "om", lambda x: x.select("1-URGENT", "5-LOW").rename({"5-LOW": "low"}), rows_sql("value", "(SELECT CASE series WHEN '5-LOW' THEN 'low' ELSE series END AS series, t, value FROM om WHERE series IN ('1-URGENT', '5-LOW'))"))
ask("ts_drop", "om", lambda x: x.drop("1-URGENT", "5-LOW"), rows_sql("value", where="WHERE series NOT IN ('1-URGENT', '5-LOW')"))
ask("ts_combine", ("om", "lm"), lambda a, b: a.combine(b), "SELECT series, t, round(value, 4) AS value FROM (SELECT * FROM om UNION ALL SELECT * FROM lm)")
for _m, _s in (("first", "coalesce(x.value, y.value)"), ("sum", "coalesce(x.value, 0) + coalesce(y.value, 0)"), ("average", "CASE WHEN x.value IS NULL THEN y.value WHEN y.value IS NULL THEN x.value ELSE (x.value + y.value) / 2 END"), ("max", "greatest(x.value, y.value)"), ("min", "least(x.value, y.value)")):
    ask(f"ts_merge_{_m}", ("x", "y"), lambda a, b, m=_m: TsFrame.merge([a, b], None if m == "first" else m), f"SELECT 'merged' AS series, coalesce(x.t, y.t) AS t, round({_s}, 4) AS value FROM x FULL JOIN y ON x.t = y.t")
ask("ts_merge_strict", ("x", "y"), lambda a, b: TsFrame.merge([a, b], "sum", False), "SELECT 'merged' AS series, coalesce(x.t, y.t) AS t, round(x.value + y.value, 4) AS value FROM x FULL JOIN y ON x.t = y.t")
ask("ts_join", ("x", "y"), lambda a, b: a.join(b, (1997, 4)), f"SELECT 'joined' AS series, t, round(value, 4) AS value FROM (SELECT * FROM x WHERE t < {1997 * 12 + 3} UNION ALL SELECT * FROM y WHERE t >= {1997 * 12 + 3})")

UP = 2003 * 12 + 5
DOWN = 1994 * 12 + 6
_facts = ", ".join(f"max(CASE WHEN t = a + {k} THEN value END) AS a{k}, max(CASE WHEN t = b - {k} THEN value END) AS b{k}" for k in range(8))
EXTENDED = f"""(SELECT e.series, e.t, o.value, e.a - e.t AS da, e.t - e.b AS db, e.* EXCLUDE (series, t)
    FROM (SELECT *, unnest(generate_series(least(a, {DOWN}), greatest(b, {UP}))) AS t FROM (SELECT series, a, b, {_facts} FROM (SELECT *, min(t) OVER (PARTITION BY series) AS a, max(t) OVER (PARTITION BY series) AS b FROM om) GROUP BY series, a, b)) e
    LEFT JOIN om o ON o.series = e.series AND o.t = e.t)"""
for _mode, _value in (
    ("missing", "NULL"), ("zero", "0"), ("constant", "{e}0"), ("mean4", "({e}0 + {e}1 + {e}2 + {e}3) / 4"), ("growth", "{e}0 * pow({e}0 / {e}1, d{e})"),
    ("growth4", "{e}0 * pow(pow(({e}0 + {e}1 + {e}2 + {e}3) / ({e}4 + {e}5 + {e}6 + {e}7), 0.25), d{e})"), ("linear", "{e}0 + d{e} * ({e}0 - {e}1)"),
    ("quadratic", "{e}0 + ((3 * {e}0 - 4 * {e}1 + {e}2) / 2 + ({e}0 - 2 * {e}1 + {e}2) / 2 * d{e}) * d{e}"), ("myconst", "5"), ("myrate", "{e}0 * pow(1.01, d{e})"),
):
    _far = _mode in ("growth", "growth4", "quadratic")  # far values differ by many orders: their logarithms are compared
    _sql = "coalesce(value, 0)" if _mode == "zero" else f"CASE WHEN da > 0 THEN {_value.format(e='a')} WHEN db > 0 THEN {_value.format(e='b')} ELSE value END"

    def _extended(x: TsFrame, m: str = _mode, far: bool = _far) -> TsFrame:
        y = x.extend((1994, 7), (2003, 6), m, {"myconst": 5.0, "myrate": 1.01}.get(m))
        return abs(y).log() if far else y

    ask(f"ts_extend_{_mode}", "om", _extended, rows_sql(f"ln(abs({_sql}))" if _far else _sql, EXTENDED))

_agg = {"sum": "CASE WHEN count(value) = count(*) THEN sum(value) END", "nsum": "sum(value)", "average": "CASE WHEN count(value) = count(*) THEN avg(value) END", "naverage": "avg(value)"}
for _name, _f in (("annual", 1), ("semiannual", 2), ("quarterly", 4)):
    _r = 12 // _f
    for _m, _v in _agg.items():
        ask(f"ts_{_name}_{_m}", "om", lambda x, f=_f, m=_m: convert(holed(x) if m[0] == "n" else x, f, m), f"SELECT series, t // {_r} AS t, round({_v}, 4) AS value FROM {HOLE if _m[0] == 'n' else 'om'} GROUP BY 1, 2 HAVING count(*) = {_r}")
    ask(f"ts_{_name}_stock", "om", lambda x, f=_f: convert(holed(x), f, "stock"), f"SELECT series, t // {_r} AS t, round(value, 4) AS value FROM {HOLE} WHERE t % {_r} = {_r - 1}")
    ask(f"ts_{_name}_nstock", "om", lambda x, f=_f: convert(holed(x), f, "nstock"), f"SELECT series, t // {_r} AS t, round(arg_max(value, CASE WHEN value IS NOT NULL THEN t END), 4) AS value FROM {HOLE} GROUP BY 1, 2 HAVING max(t % {_r}) = {_r - 1}")
ask("ts_monthly_from_daily", "ed", lambda x: convert(x, 12, "nsum"), "SELECT series, (t // 366) * 12 + month(d) - 1 AS t, round(sum(value), 4) AS value FROM (SELECT *, make_date(CAST(t // 366 AS INT), 1, 1) + CAST(t % 366 AS INT) AS d FROM ed) GROUP BY 1, 2 HAVING count(*) = 31")
ask("ts_monthly_stock_from_daily", "ed", lambda x: convert(x, 12, "stock"), "SELECT series, (t // 366) * 12 + month(d) - 1 AS t, round(value, 4) AS value FROM (SELECT *, make_date(CAST(t // 366 AS INT), 1, 1) + CAST(t % 366 AS INT) AS d FROM ed) WHERE day(d) = 31")
QTR = "(SELECT series, t // 3 AS t, sum(value) AS value FROM om GROUP BY 1, 2 HAVING count(*) = 3)"
quarters = lambda x: convert(x, 4, "nsum")
ask("ts_repeat_q2m", "om", lambda x: convert(quarters(x), 12, "repeat"), f"SELECT series, t * 3 + k AS t, round(value, 4) AS value FROM {QTR}, (SELECT unnest([0, 1, 2]) AS k)")
ask("ts_repeat_q2d", "om", lambda x: convert(quarters(x), 366, "repeat"), f"""SELECT series, unnest(generate_series((t // 4) * 366 + dayofyear(a) - 1, (t // 4) * 366 + CASE WHEN t % 4 = 3 THEN 366 ELSE dayofyear(b) END - 1)) AS t, round(value, 4) AS value
    FROM (SELECT *, make_date(CAST(t // 4 AS INT), CAST(t % 4 * 3 + 1 AS INT), 1) AS a, last_day(make_date(CAST(t // 4 AS INT), CAST(t % 4 * 3 + 3 AS INT), 1)) AS b FROM {QTR})""")
for _m, _o in (("begin", 0), ("center", 1), ("end", 2)):
    ask(f"ts_interp_{_m}", "om", lambda x, m=_m: convert(quarters(x), 12, f"interp_{m}"), f"""SELECT series, t * 3 + {_o} + k AS t, round(CASE WHEN k = 0 THEN value ELSE value + k * (nx - value) / 3 END, 4) AS value
        FROM (SELECT *, lead(value) {W_} AS nx, lead(t) {W_} AS nt FROM {QTR}), (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR nt IS NOT NULL""")
ask("ts_interp_daily_begin", "om", lambda x: convert(convert(x, 1, "nsum"), 366, "interp_begin"), f"""SELECT series, t * 366 + k AS t, round(CASE WHEN k = 0 THEN value ELSE value + k * (nx - value) / 366 END, 4) AS value
    FROM (SELECT *, lead(value) {W_} AS nx FROM (SELECT series, t // 12 AS t, sum(value) AS value FROM om GROUP BY 1, 2 HAVING count(*) = 12)), (SELECT unnest(generate_series(0, 365)) AS k) WHERE k = 0 OR nx IS NOT NULL""")



def through_text(x: TsFrame, merged: bool) -> TsFrame:
    """The frame written to a file by the driver and read back."""
    with tempfile.TemporaryDirectory() as folder:
        exchange.write_text(x, f"{folder}/x.csv", merged=merged)
        return exchange.read_text(x.df.sparkSession, f"{folder}/x.csv", merged=merged)[x.freq]


ask("csv_round_trip_paired", "om", lambda x: through_text(x, False), rows_sql("value"))
ask("csv_round_trip_merged", ("x",), lambda x: through_text(x, True), "SELECT '1-URGENT' AS series, t, round(value, 4) AS value FROM x")
ask("pandas_round_trip", ("x",), lambda x: exchange.from_pandas(x.df.sparkSession, exchange.to_pandas(x)), "SELECT '1-URGENT' AS series, t, round(value, 4) AS value FROM x")
ask("ts_map", "om", lambda x: x.map(lambda p: p.assign(value=p.value * 2)), rows_sql("value * 2"))

BOTH = "x JOIN y ON x.t = y.t"
for _n, _o, _fn in (("lt", "<", lambda a, b: a < b), ("le", "<=", lambda a, b: a <= b), ("gt", ">", lambda a, b: a > b), ("ge", ">=", lambda a, b: a >= b), ("eq", "=", lambda a, b: a == b), ("ne", "<>", lambda a, b: a != b)):
    ask(f"ts_compare_{_n}", ("x", "y"), lambda a, b, fn=_fn: a.combine_values(b, fn), f"SELECT 'result' AS series, x.t, x.value {_o} y.value AS value FROM {BOTH}")
_ma, _mb = f"(SELECT t, CASE WHEN t % 5 <> 0 THEN value END > 1e6 AS value FROM x)", "(SELECT t, CASE WHEN t % 3 <> 0 THEN value END > 2e6 AS value FROM y)"  # noqa: F541


def masks(a: TsFrame, b: TsFrame) -> tuple[TsFrame, TsFrame]:
    return holed(a) > 1e6, b.keep(b.df.withColumn(V, F.when(F.col(T) % 3 != 0, F.col(V)))) > 2e6


for _n, _o, _fn in (("and", "AND", lambda a, b: a & b), ("or", "OR", lambda a, b: a | b), ("xor", "<>", lambda a, b: a != b)):
    ask(f"mask_{_n}", ("x", "y"), lambda a, b, fn=_fn: masks(a, b)[0].combine_values(masks(a, b)[1], fn), f"SELECT 'result' AS series, a.t, a.value {_o} b.value AS value FROM {_ma} a JOIN {_mb} b ON a.t = b.t")
ask("mask_not", ("x", "y"), lambda a, b: ~masks(a, b)[0], f"SELECT '1-URGENT' AS series, t, NOT value AS value FROM {_ma}")
ask("mask_any", "om", lambda x: (holed(x) > 1e6).any(), f"SELECT series, coalesce(bool_or(value > 1e6), false) AS result FROM {HOLE} GROUP BY 1")
ask("mask_all", "om", lambda x: (holed(x) > 1e3).all(False), f"SELECT series, CASE WHEN NOT bool_and(value > 1e3) THEN false WHEN count(*) > count(value) THEN NULL ELSE true END AS result FROM {HOLE} GROUP BY 1")
for _n, _o, _fn in (("add", "x.value + y.value", lambda a, b: a + b), ("sub", "x.value - y.value", lambda a, b: a - b), ("mul", "x.value * y.value / 1e6", lambda a, b: a * b / 1e6), ("div", "x.value / y.value", lambda a, b: a / b)):
    ask(f"ts_arith_{_n}", ("x", "y"), lambda a, b, fn=_fn: fn(a.rename({PRIORITY: "x"}), b.rename({FLAG: "x"})), f"SELECT 'x' AS series, x.t, round({_o}, 4) AS value FROM {BOTH}")
ask("ts_div_by_zero", "om", lambda x: (x * 0.0 - x) / (x * 0.0), "SELECT series, t, CASE WHEN value > 0 THEN CAST('-Infinity' AS DOUBLE) END AS value FROM om")
ask("ts_mod", "om", lambda x: x % -7.0, rows_sql("value - -7.0 * floor(value / -7.0)"))
ask("ts_floordiv", "om", lambda x: x // 1000.0, rows_sql("floor(value / 1000.0)"))
ask("ts_pow", "om", lambda x: x**0.5, rows_sql("pow(value, 0.5)"))
ask("ts_unary", "om", lambda x: abs(-x), rows_sql("value"))
ask("ts_log", "om", lambda x: x.log(), rows_sql("ln(value)"))
ask("ts_exp", "om", lambda x: (x / 1e8).exp(), rows_sql("exp(value / 1e8)"))

ask("ts_range", "om", lambda x: x.ranges(), "SELECT max(a) AS inner_start, min(b) AS inner_end, min(a) AS outer_start, max(b) AS outer_end FROM (SELECT min(t) AS a, max(t) AS b FROM om GROUP BY series)")
for _k, _a, _b in (("inner", "max(a)", "min(b)"), ("outer", "min(a)", "max(b)")):
    ask(f"ts_align_{_k}", ("om",), lambda x, k=_k: x.align(k), f"SELECT s.series, g.t, round(om.value, 4) AS value FROM (SELECT DISTINCT series FROM om) s CROSS JOIN (SELECT unnest(generate_series(a, b)) AS t FROM (SELECT {_a} AS a, {_b} AS b FROM (SELECT min(t) AS a, max(t) AS b FROM om GROUP BY series))) g LEFT JOIN om ON om.series = s.series AND om.t = g.t")
ask("ts_info", "om", lambda x: x.info(), "SELECT series, 12 AS freq, CAST(min(t) // 12 AS INT) AS start_year, CAST(min(t) % 12 + 1 AS INT) AS start_period, CAST(max(t) // 12 AS INT) AS end_year, CAST(max(t) % 12 + 1 AS INT) AS end_period, count(*) AS length, count(*) - count(value) AS missing FROM om GROUP BY series")
ask("ts_tabulate", "om", lambda x: x.select("1-URGENT", "5-LOW").rename({"1-URGENT": "urgent", "5-LOW": "low"}).tabulate(["urgent", "low"]), """SELECT g.t, CAST(g.t // 12 AS INT) AS year, CAST(g.t % 12 + 1 AS INT) AS period, round(a.value, 4) AS urgent, round(b.value, 4) AS low
    FROM (SELECT unnest(generate_series(min(t), max(t))) AS t FROM om WHERE series IN ('1-URGENT', '5-LOW')) g LEFT JOIN om a ON a.t = g.t AND a.series = '1-URGENT' LEFT JOIN om b ON b.t = g.t AND b.series = '5-LOW'""")
ask("ts_magnitude", "om", lambda x: x.magnitude(), "SELECT series, round(sqrt(sum(value * value)), 4) AS magnitude FROM om GROUP BY 1")
ask("ts_verify_magnitude", "om", lambda x: x.verify_magnitude(1e6), "SELECT series, round(sqrt(sum(value * value)), 4) AS magnitude FROM om GROUP BY 1 HAVING sqrt(sum(value * value)) > 1e6")
ask("cal_year_periods", "om", lambda x: x.year_periods(), "SELECT series, t, CAST(t // 12 AS INT) AS year, CAST(t % 12 + 1 AS INT) AS period FROM om")
ask("cal_dates_last", "om", lambda x: x.with_dates().withColumn("date", F.col("date").cast("string")), "SELECT series, t, CAST(last_day(make_date(CAST(t // 12 AS INT), CAST(t % 12 + 1 AS INT), 1)) AS VARCHAR) AS date FROM om")
ask("cal_dates_first", "om", lambda x: x.with_dates(False).withColumn("date", F.col("date").cast("string")), "SELECT series, t, CAST(make_date(CAST(t // 12 AS INT), CAST(t % 12 + 1 AS INT), 1) AS VARCHAR) AS date FROM om")
ask("cal_dates_quarter", "om", lambda x: x.with_dates(True, "%Y-Q%q"), "SELECT series, t, CAST(t // 12 AS VARCHAR) || '-Q' || CAST(t % 12 // 3 + 1 AS VARCHAR) AS date FROM om")

_PERIOD = {1: "1", 2: "(m * 2 - 1) // 12 + 1", 3: "(m * 3 - 1) // 12 + 1", 4: "(m * 4 - 1) // 12 + 1", 12: "m", 24: "(m - 1) * 2 + 1 + CASE WHEN day(d) > 15 THEN 1 ELSE 0 END", 36: "(m - 1) * 3 + 1 + CASE WHEN day(d) > 20 THEN 2 WHEN day(d) > 10 THEN 1 ELSE 0 END", 53: "least(53, (dayofyear(d) - 1) // 7 + 1)", 366: "dayofyear(d)"}
for _f, _p in _PERIOD.items():
    def _date2yp(spark: SparkSession, sf: str, f: int = _f) -> DataFrame:
        d = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct()
        t = periods.date_to_t(F.col("d"), f)
        return d.select(F.col("d").cast("string").alias("d"), periods.year_of(t, f).alias("year"), periods.period_of(t, f).alias("period"), periods.t_to_date(t, f, False).cast("string").alias("first"))

    QUERIES[f"cal_date2yp_{_f}"] = _date2yp
    _first = {24: "make_date(CAST(year(d) AS INT), CAST(m AS INT), CASE WHEN day(d) > 15 THEN 16 ELSE 1 END)", 36: "make_date(CAST(year(d) AS INT), CAST(m AS INT), CASE WHEN day(d) > 20 THEN 21 WHEN day(d) > 10 THEN 11 ELSE 1 END)", 53: "make_date(CAST(year(d) AS INT), 1, 1) + CAST((dayofyear(d) - 1) // 7 * 7 AS INT)", 366: "d"}.get(_f, f"make_date(CAST(year(d) AS INT), CAST((m * {min(_f, 12)} - 1) // 12 * {12 // min(_f, 12)} + 1 AS INT), 1)")
    ORACLE[f"cal_date2yp_{_f}"] = f"SELECT CAST(d AS VARCHAR) AS d, CAST(year(d) AS INT) AS year, CAST({_p} AS INT) AS period, CAST({_first} AS VARCHAR) AS first FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, month(o_orderdate) AS m FROM orders)"
