import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perioda.functions import ieee, periods
from perioda.operators import api
from perioda.operators.frame import TsFrame
from perioda.operators.resample import convert
from perioda.sources import exchange

NA = None


def ts(spark, values, start=(2000, 1), freq=1, **k):
    return TsFrame.of(spark, values, start, freq, **k)


def near(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=tol, abs_tol=tol)), (a, b)


def test_frequencies():
    assert [periods.frequency(x) for x in ("a", " Q ", "m", "D", 53, "24")] == [1, 4, 12, 366, 53, 24]
    for bad in (5, "x", "0"):
        with pytest.raises(ValueError):
            periods.frequency(bad)
    with pytest.raises(TypeError):
        periods.frequency(True)


def test_year_periods():
    assert periods.normalize_year_period((2, 13), 4) == (5, 1)
    assert periods.num_periods((2, 3), (3, 4), 5) == 6


@pytest.mark.parametrize("freq", periods.FREQUENCIES)
def test_calendar_columns_agree_with_driver(spark, freq):
    days = [dt.date(1999, 12, 31) + dt.timedelta(i) for i in range(0, 800, 3)]
    t = periods.date_to_t(F.col("d"), freq)
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", t.alias("t"), periods.t_to_date(t, freq, False).alias("a"), periods.t_to_date(t, freq, True).alias("b")).collect()
    for r in rows:
        yp = periods.date_to_year_period(r["d"], freq)
        assert periods.year_period(r["t"], freq) == yp
        assert (r["a"], r["b"]) == (periods.year_period_to_date(yp, freq, False), periods.year_period_to_date(yp, freq, True))
        assert r["a"] <= r["d"] <= r["b"]


def test_slot_366():
    assert periods.year_period_to_date((2001, 366), 366) is None
    assert periods.year_period_to_date((2000, 366), 366) == dt.date(2000, 12, 31)


def test_ieee(spark):
    values = [-2.5, -1.0, 0.0, 0.3, 7.0, math.inf, None]
    rows = [(a, b) for a in values for b in values]
    f = lambda g: g(F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", f(ieee.div).alias("div"), f(ieee.floordiv).alias("fd"), f(ieee.mod).alias("mod"), f(ieee.power).alias("pow"), ieee.ln(F.col("a")).alias("ln")).collect()
    with np.errstate(all="ignore"):
        for r in got:
            a, b = (np.float64("nan") if x is None else np.float64(x) for x in (r["a"], r["b"]))
            want = {"div": a / b, "pow": np.power(a, b), "ln": np.log(a)}
            if np.isfinite([a, b]).all():
                want |= {"fd": np.floor(a / b), "mod": np.remainder(a, b)}
            for k, w in want.items():
                assert (r[k] is None and np.isnan(w)) or math.isclose(r[k], w, abs_tol=1e-12), (k, a, b, r[k], w)


def test_constructor(spark):
    x = ts(spark, [5, *range(1, 11), NA, 8], (2020, 1))
    assert x.values() == [5.0, *map(float, range(1, 11)), None, 8.0]
    with pytest.raises(ValueError):
        ts(spark, [])
    with pytest.raises(ValueError):
        ts(spark, [1], scale_factor=-1)
    assert ts(spark, [1], units="m", scale_factor=3).meta["x"] == {"units": "m", "scale_factor": 3}


def test_lags_and_differences(spark):
    x = ts(spark, range(1, 11))
    assert x.lag(5).range() == ((2005, 1), (2014, 1)) and x.lead(5).range() == ((1995, 1), (2004, 1))
    for order in (1, 2, 3):
        near(x.delta(1, order).values(), [1.0 if order == 1 else 0.0] * (10 - order))
    near(x.delta_log().values(), list(np.diff(np.log(np.arange(1, 11)))))
    q = ts(spark, range(10, -1, -1), freq=4).delta_percent()
    near(q.values(), [100 * (b / a - 1) for a, b in zip(range(10, 0, -1), range(9, -1, -1))])
    d = [1 - 0.001 * k for k in range(10)]
    near(ts(spark, d, freq=366).delta_percent(1, True).values(), [100 * ((b / a) ** 366 - 1) for a, b in zip(d, d[1:])])
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            x.delta(bad)
    with pytest.raises(ValueError):
        ts(spark, [1, 2], freq=4).delta_percent(3, True)


def test_transform_chain(spark):
    x = ts(spark, [1.0, NA, 3.0, 4.0, 5.0], freq=4).cumulative_sum(skip_missing=True)
    assert x.values() == [1.0, 1.0, 4.0, 8.0, 13.0]


def test_projection_and_trim(spark):
    x = ts(spark, range(1, 11))
    assert x.project((2002, 1), (2005, 1)).values() == [3.0, 4.0, 5.0, 6.0]
    assert x.project((1998, 1), (2002, 1), True).values() == [None, None, 1.0, 2.0, 3.0]
    y = ts(spark, [NA, *range(1, 11), NA])
    assert y.trim().values() == [float(v) for v in range(1, 11)]
    assert len(y.trim(leading=False).values()) == len(y.trim(trailing=False).values()) == 11
    assert ts(spark, [0, 0, NA, 1, 2, NA, 0]).trim(0).values() == [None, 1.0, 2.0, None]
    assert ts(spark, [NA, NA]).trim().values() == []
    assert x.position(-3).values() == [8.0, 9.0, 10.0]
    with pytest.raises(ValueError):
        x.project((2005, 1), (2002, 1))


def test_date_selectors(spark):
    m = ts(spark, range(24), (2000, 1), 12)
    assert m.dates("2001").values() == [float(v) for v in range(12, 24)]
    assert m.dates("2000-03").values() == [2.0]
    assert m.dates("/2000-02").values() == [0.0, 1.0] and m.dates("2001-11/").values() == [22.0, 23.0]
    assert m.dates(dt.date(2000, 5, 17)).values() == [4.0]


def test_updates(spark):
    x = ts(spark, [1, 2, 3])
    assert x.with_values((2001, 1), 9.0).values() == [1.0, 9.0, 3.0]
    assert x.with_values((2004, 1), [5, 6]).values() == [1.0, 2.0, 3.0, None, 5.0, 6.0]
    assert x.with_values((2002, 1), [5, 6], extend=False).values() == [1.0, 2.0, 5.0]


def test_running_windows(spark):
    v = [1.0, NA, 2.0, 3.0, 4.0]
    x = ts(spark, v, freq=4)
    assert x.cumulative_sum().values() == [1.0, None, None, None, None]
    assert x.cumulative_sum("yearly").values() == [1.0, None, None, None, 4.0]
    assert x.cumulative_product(True).values() == [1.0, 1.0, 2.0, 6.0, 24.0]
    assert x.moving_average(2).values() == [None, None, 2.5, 3.5]
    assert x.moving_sum(3, skip_missing=True).values() == [3.0, 5.0, 9.0]
    assert x.moving_average(3, "center").range() == ((2000, 2), (2000, 4)) and x.moving_average(3, "ahead").range() == ((2000, 1), (2000, 3))


def test_index_number(spark):
    near(ts(spark, [2, 4, 6, 8], freq=2).index_number(2000).values(), [200 / 3, 400 / 3, 200, 800 / 3])
    with pytest.raises(Exception, match="absent"):
        ts(spark, [1.0]).index_number(1990).values()


@pytest.mark.parametrize("mode,want", [("constant", 8.0), ("growth", 10 + 2 / 3), ("linear", 10.0), ("mean4", 5.0), ("quadratic", 10.0), ("myconst", 7.0), ("myrate", 16.0), ("missing", None), ("zero", 0.0)])
def test_extend(spark, mode, want):
    x = ts(spark, [2, 4, 6, 8])
    got = x.extend(up_to=(2004, 1), mode=mode, factor={"myconst": 7, "myrate": 2}.get(mode)).values()
    near(got, [2.0, 4.0, 6.0, 8.0, want])


def test_extend_overwrites_missing_edge(spark):
    assert ts(spark, [1, 2, NA]).extend(up_to=(2003, 1), mode="constant").values() == [1.0, 2.0, 2.0, 2.0]
    assert ts(spark, [NA, 2, 3]).extend(up_to=(2003, 1), mode="constant").values() == [None, 2.0, 3.0, 3.0]
    assert ts(spark, [NA, NA]).extend(up_to=(2002, 1), mode="constant").values() == [None] * 3


def test_merge_and_join(spark):
    a, b = ts(spark, [1, NA, 3]), ts(spark, [10, 20, 30, 40], (2001, 1))
    assert TsFrame.merge([a, b]).values() == [1.0, 10.0, 3.0, 30.0, 40.0]
    assert TsFrame.merge([a, b], skip_missing=False).values() == [1.0, 10.0, 3.0, None, None]
    assert TsFrame.merge([a, b], "sum").values() == [1.0, 10.0, 23.0, 30.0, 40.0]
    assert TsFrame.merge([a, b], "sum", False).values() == [None, None, 23.0, None, None]
    assert a.join(b).values() == [1.0, 10.0, 20.0, 30.0, 40.0]
    assert a.join(b, (2003, 1), allow_gap=True).values() == [1.0, None, 3.0, 30.0, 40.0]
    with pytest.raises(Exception, match="gap"):
        ts(spark, [1.0]).join(ts(spark, [2.0], (2005, 1))).values()


def test_aggregation(spark):
    x = ts(spark, [1, 2, NA, 4, 5, 6, 7], freq=4)
    assert convert(x, 1, "sum").values() == [None] and convert(x, 1, "nsum").values() == [7.0]
    near(convert(x, 1, "naverage").values(), [7 / 3])
    assert convert(ts(spark, [1, 2, NA], (2000, 2), 4), 1, "stock").values() == [None]
    assert convert(ts(spark, [1, 2, NA], (2000, 2), 4), 1, "nstock").values() == [2.0]
    with pytest.raises(ValueError):
        convert(x, 1)
    days = ts(spark, range(366), (2001, 1), 366)
    assert convert(days, 12, "nsum").values()[0] == sum(range(31))
    assert len(convert(days, 1, "sum").values()) == 1


def test_disaggregation(spark):
    x = ts(spark, [1, 3])
    assert convert(x, 4, "repeat").values() == [1.0] * 4 + [3.0] * 4
    near(convert(x, 4, "interp_end").values(), [1.0, 1.5, 2.0, 2.5, 3.0])
    assert convert(x, 4, "interp_begin").range() == ((2000, 1), (2001, 1)) and convert(x, 4, "interp_center").range() == ((2000, 3), (2001, 3))
    d = convert(ts(spark, [1, 2], (2001, 4), 4), 366, "repeat")
    assert d.range() == ((2001, 274), (2002, 90))
    assert len(d.values()) == 93 + 90
    assert convert(ts(spark, [1, 2], (2000, 1), 4), 366, "interp_center").range() == ((2000, 46), (2000, 136))


def test_masks(spark):
    a = ts(spark, [1, NA, 3]) > 1
    assert a.values() == [False, None, True] and (~a).values() == [True, None, False]
    assert [r["result"] for r in a.any().collect()] == [True] and [r["result"] for r in a.all(False).collect()] == [False]
    with pytest.raises(TypeError):
        ts(spark, [1.0]) > True


def test_dataset_edits(spark):
    both = ts(spark, [1, 2], name="a").combine(ts(spark, [3], name="b"))
    assert sorted(r[0] for r in both.info().select("series").collect()) == ["a", "b"]
    assert both.drop("a").values() == [3.0] and both.rename({"b": "c"}).select("c").values() == [3.0]
    assert both.align("inner").df.count() == 2 and both.align("outer").df.count() == 4
    with pytest.raises(Exception, match="exists"):
        both.combine(ts(spark, [9], name="a")).df.collect()
    assert both.combine(ts(spark, [9], name="a"), replace=True).select("a").values() == [9.0]
    assert both.map(lambda p: p.assign(value=p.value * 2)).select("b").values() == [6.0]
    assert api.tsinfo(both.select("a"), "END2") == (2001, 1)


def test_display(spark):
    text = api.display(ts(spark, [1, 2, 3], (2000, 2), 4))
    assert text.splitlines()[0].split() == ["Q1", "Q2", "Q3", "Q4"] and text.splitlines()[1].split() == ["2000", "1", "2", "3"]


@pytest.mark.parametrize("merged", [True, False])
@pytest.mark.parametrize("how", [{}, {"delimiter": ";", "decimal_separator": ","}])
def test_text_round_trip(spark, tmp_path, merged, how):
    x = ts(spark, [1.5, NA, 3.25], (2000, 3), 4, name="gdp").combine(ts(spark, [7, 8], (2001, 1), 4, name="cpi"))
    path = str(tmp_path / "x.csv")
    exchange.write_text(x, path, merged=merged, **how)
    back = exchange.read_text(spark, path, merged=merged, **how)[4]
    assert back.select("gdp").trim().values() == [1.5, None, 3.25] and back.select("cpi").trim().values() == [7.0, 8.0]
    with pytest.raises(FileExistsError):
        exchange.write_text(x, path)


def test_text_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,x\n2000-01-31,1\n2000-02-29,2\n2000-04-30,NA\n")
    got = exchange.read_text(spark, str(tmp_path / "a.csv"), merged=True)
    assert list(got) == [12] and got[12].values() == [1.0, 2.0, None, None]
    (tmp_path / "b.csv").write_text("skip me\nFREQ_4,x\n2000-Q2,1\n2000-Q3,2\n")
    assert exchange.read_text(spark, str(tmp_path / "b.csv"), merged=True, date_format="%Y-Q%q", skip_lines=1)[4].range() == ((2000, 2), (2000, 3))
    (tmp_path / "c.csv").write_text("FREQ_366,x\n2001-P365,1\n2001-P366,2\n")
    assert exchange.read_text(spark, str(tmp_path / "c.csv"), merged=True)[366].values() == [1.0, 2.0]
    (tmp_path / "d.csv").write_text("d,x\n2000-02-01,1\n2000-01-01,2\n")
    with pytest.raises(ValueError):
        exchange.read_text(spark, str(tmp_path / "d.csv"), merged=True)


@pytest.mark.parametrize("index", ["year-period", "period", "datetime"])
def test_pandas_round_trip(spark, index):
    x = ts(spark, [1.5, NA, 3.0], (2000, 3), 4)
    back = exchange.from_pandas(spark, exchange.to_pandas(x, index))
    assert back.values() == x.values() and back.freq == 4 and back.range() == x.range()


def test_pandas_faults(spark):
    with pytest.raises(ValueError):
        exchange.from_pandas(spark, pd.Series([1.0, 2.0], index=pd.to_datetime(["2000-01-01", "2000-01-02"])))


def test_streaming_ingest(spark, tmp_path):
    from perioda.streaming import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2024, 1, d, 5), "a", float(d)) for d in range(1, 6)], "ts timestamp, k string, v double").write.parquet(src)
    q = ingest.start(spark.readStream.schema("ts timestamp, k string, v double").parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), time="ts", series="k", value="v")
    q.awaitTermination(60)
    rows = {r["__t"] % 366 + 1: r["value"] for r in ingest.latest(spark, str(tmp_path / "out")).collect()}
    assert rows.items() <= {d: float(d) for d in range(1, 6)}.items()


def test_streaming_months_add_up_over_batches(spark, tmp_path):
    from perioda.streaming import ingest

    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "ts timestamp, k string, v double"
    for lo, hi in ((1, 11), (11, 21), (21, 32)):
        spark.createDataFrame([(dt.datetime(2024, 1, d, 5), "a", float(d)) for d in range(lo, hi)] + ([(dt.datetime(2024, 2, 9), "a", 1.0)] if hi == 32 else []), schema).write.mode("append").parquet(src)
        ingest.start(spark.readStream.schema(schema).parquet(src), out, cp, time="ts", series="k", value="v").awaitTermination(60)
    rows = {(r["__t"] // 12, r["__t"] % 12 + 1): r["value"] for r in ingest.latest(spark, out, 12).collect()}
    assert rows[2024, 1] == sum(range(1, 32))


def test_lookups_and_errors(spark):
    x = TsFrame.of(spark, [1.0, None, 3.0, 4.0, 5.0], (2000, 1), 4, "x")
    assert x.at_period(2000, 3).first()["value"] == 3.0 and x.at_date(dt.date(2000, 11, 5)).first()["value"] == 4.0
    assert tuple(x.period_at(-1).first())[2:] == (2001, 1)
    assert x.between_dates(dt.date(2000, 5, 1), dt.date(2000, 9, 9)).values() == [None, 3.0]
    assert x[[2000, 3]].values() == [3.0] and x[[[2000, 3], [2000, 4]]].values() == [3.0, 4.0] and x[-1].values() == [5.0] and x[1:3].values() == [None, 3.0]
    assert x["2001"].values() == [5.0] and x[x > 3.5].values() == [4.0, 5.0]
    assert x.with_items({(2001, 3): 9.0, (2000, 2): 2.0}).values() == [1.0, 2.0, 3.0, 4.0, 5.0, None, 9.0]
    assert x.assign_range((2000, 1), (2000, 2), {"x": [7.0, 8.0]}).values() == [7.0, 8.0, 3.0, 4.0, 5.0]
    assert sorted(r["series"] for r in x.with_series(x.rename({"x": "y"})).rows().collect()) == ["x"] * 5 + ["y"] * 5
    far = TsFrame.of(spark, [1.0], (2010, 1), 4, "y")
    two = x.combine(x.rename({"x": "z"}))
    for wrong in (lambda: x.at_period(1999, 4).collect(), lambda: x.period_at(5).collect(), lambda: x.assign_range((2000, 1), (2000, 1), {"no": 1.0}).values(),
                  lambda: x.combine_values(far, lambda a, b: a + b).values(), lambda: two.combine_values(x, lambda a, b: a + b).values(), lambda: convert(far, 1, "sum", strict=True).values()):
        with pytest.raises(Exception):
            wrong()
