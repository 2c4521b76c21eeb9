"""Registered queries of the model operators, each over the monthly order values of every priority (one group of data each).

x is a month's value in millions. Simulated models are linear, so SQL gives their solutions in closed form or by recursion.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import estimate as est
from ..model import simulate as sim
from ..model import spark as ms
from ..model.parse import load_model
from ..model.rng import RStream
from ..operators.frame import S, T, V
from .series_queries import SQL, om

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RANGE = ((1996, 1), (1998, 12))
LO, HI = 1996 * 12, 1998 * 12 + 11
SHORT = ((1996, 1), (1996, 4))
MULTIPLIER = """MODEL
IDENTITY> c
EQ> c = 0.6*y + 0.2*TSLAG(c,1)
IDENTITY> y
EQ> y = c + x
END"""
TIGHT = {"convergence": 1e-10, "max_iterations": 500}
WIDE = "wide AS (SELECT series, t, coalesce(value, 1000000) / 1e6 AS x, coalesce(value, 1000000) / 1e6 AS c, 2 * coalesce(value, 1000000) / 1e6 AS y FROM om)"


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """(series, __t, x, c, y): c is x and y is 2x as history; gaps count as a million."""
    x = F.coalesce(F.col(V), F.lit(1e6)) / F.lit(1e6)
    return om(spark, sf).df.select(F.col(S).alias("series"), T, x.alias("x"), x.alias("c"), (2 * x).alias("y"))


def ask(name: str, function: Callable[[DataFrame], DataFrame], select: str = "", digits: int = 4) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = function(wide(spark, sf))
        names = {"__t": "t", "__series": "variable", "__replica": "replica"}
        return df.select(*[(F.round(c, digits) if k == "double" else F.col(f"`{c}`")).alias(names.get(c, c)) for c, k in df.dtypes])

    QUERIES[name] = run
    if select:
        ORACLE[name] = f"WITH RECURSIVE {SQL['om']}, {WIDE}{', ' if select.startswith('r(') or select.startswith('q AS') else ' '}{select}"


G = ["series"]
ask("mdl_eval_expr", lambda w: ms.evaluate_frame(w, "LOG(x) + 0.5*TSLAG(x,2) - MOVAVG(x,3)/TSLEAD(x)", G),
    "SELECT series, t, round(ln(x) + 0.5 * l2 - (l2 + l1 + x) / 3 / n1, 6) AS value FROM (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lead(x, 1) OVER w AS n1 FROM wide WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE l2 IS NOT NULL AND n1 IS NOT NULL", 6)
ask("mdl_eval_growth", lambda w: ms.evaluate_frame(w, "TSDELTAP(x,12) - TSDELTA(x) + TSDELTALOG(x)*ABS(-x)^0.5", G),
    "SELECT series, t, round(100 * (x / l12 - 1) - (x - l1) + (ln(x) - ln(l1)) * sqrt(x), 6) AS value FROM (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 12) OVER w AS l12 FROM wide WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE l12 IS NOT NULL", 6)
ask("mdl_eval_condition", lambda w: ms.evaluate_frame(w, "x > TSLAG(x) & x < 100", G), "SELECT series, t, x > l1 AND x < 100 AS value FROM (SELECT *, lag(x, 1) OVER (PARTITION BY series ORDER BY t) AS l1 FROM wide) WHERE l1 IS NOT NULL")

CHECKED = """MODEL
BEHAVIORAL> c
EQ> LOG(c) = a1 + a2*y + a3*TSLAG(c,1)
COEFF> a1 a2 a3
IDENTITY> y
EQ> y = c + x
END"""
ask("mdl_rescheck", lambda w: ms.residual_check_frame(w, load_model(model_text=CHECKED), {"c": {"a1": 0.1, "a2": 0.02, "a3": 0.01}}, LO, HI, G),
    f"""q AS (SELECT *, lag(c, 1) OVER (PARTITION BY series ORDER BY t) AS l1 FROM wide)
    SELECT series, 'c' AS variable, t, round(exp(0.1 + 0.02 * y + 0.01 * l1), 4) AS fitted, round(ln(c) - (0.1 + 0.02 * y + 0.01 * l1), 4) AS add_factor FROM q WHERE t BETWEEN {LO} AND {HI}
    UNION ALL SELECT series, 'y', t, round(c + x, 4), round(y - (c + x), 4) + 0.0 FROM q WHERE t BETWEEN {LO} AND {HI}""")  # fmt: skip
CONDITIONAL = """MODEL
IDENTITY> c
EQ> c = 2*x
IF> x > 10
IDENTITY> c
EQ> c = x/2
IF> x <= 5
IDENTITY> y
EQ> y = c + TSLAG(x,1)
END"""
ask("mdl_conditional_identity", lambda w: ms.simulate_frame(w, CONDITIONAL, 12, RANGE, G),
    f"""q AS (SELECT series, t, CASE WHEN x > 10 THEN 2 * x WHEN x <= 5 THEN x / 2 ELSE c END AS cc, lag(x, 1) OVER (PARTITION BY series ORDER BY t) AS l1 FROM wide)
    SELECT series, 'c' AS variable, t, round(cc, 4) AS value FROM q WHERE t BETWEEN {LO} AND {HI} UNION ALL SELECT series, 'y', t, round(cc + l1, 4) FROM q WHERE t BETWEEN {LO} AND {HI}""")  # fmt: skip


def solved(extra: str = "0", hi: int = HI, first: str = "t") -> str:
    """Recursion of the linear model with an add-factor on c."""
    return f"""r(series, t, c, y) AS (SELECT series, t, c, y FROM wide WHERE t = {LO - 1}
    UNION ALL SELECT w.series, w.t, (0.6 * w.x + 0.2 * r.c + ({extra})) / 0.4, (0.6 * w.x + 0.2 * r.c + ({extra})) / 0.4 + w.x FROM r JOIN wide w ON w.series = r.series AND w.t = r.t + 1 WHERE w.t <= {hi})
    SELECT series, v AS variable, t, round(CASE v WHEN 'c' THEN c ELSE y END, 4) AS value FROM r, (SELECT unnest(['c', 'y']) AS v)"""


INSIDE = f" WHERE t >= {LO}"
ask("mdl_simulate_gs", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, **TIGHT), solved() + INSIDE)
ask("mdl_simulate_newton", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, algorithm="NEWTON", **TIGHT), solved() + INSIDE)
ask("mdl_simulate_fullnewton", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, algorithm="FULLNEWTON", **TIGHT), solved() + INSIDE)
ask("mdl_jacobian_drop", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, SHORT, G, algorithm="NEWTON", jacobian_drop=("c",), **TIGHT),
    solved(hi=LO + 3) + INSIDE)

ask("mdl_add_factor", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, adjust={"c": 0.5}, **TIGHT), solved("0.5") + INSIDE)
ask("mdl_backfill", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, backfill=1, **TIGHT), solved())
ask("mdl_exogenize", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, exogenize=["c"], **TIGHT), f"SELECT series, v AS variable, t, round(CASE v WHEN 'c' THEN c ELSE c + x END, 4) AS value FROM wide, (SELECT unnest(['c', 'y']) AS v) WHERE t BETWEEN {LO} AND {HI}")
ask("mdl_simulate_static", lambda w: ms.simulate_frame(w, MULTIPLIER, 12, RANGE, G, kind="STATIC", **TIGHT),
    f"""q AS (SELECT *, lag(c, 1) OVER (PARTITION BY series ORDER BY t) AS l1 FROM wide)
    SELECT series, v AS variable, t, round(CASE v WHEN 'c' THEN (0.6 * x + 0.2 * l1) / 0.4 ELSE (0.6 * x + 0.2 * l1) / 0.4 + x END, 4) AS value FROM q, (SELECT unnest(['c', 'y']) AS v) WHERE t BETWEEN {LO} AND {HI}""")  # fmt: skip
RECURSIVE = """MODEL
IDENTITY> y
EQ> y = x + 0.5*TSLAG(y,1)
END"""
ask("mdl_simulate_dynamic_recursive", lambda w: ms.simulate_frame(w, RECURSIVE, 12, RANGE, G),
    f"""r(series, t, y) AS (SELECT series, t, y FROM wide WHERE t = {LO - 1} UNION ALL SELECT w.series, w.t, w.x + 0.5 * r.y FROM r JOIN wide w ON w.series = r.series AND w.t = r.t + 1 WHERE w.t <= {HI})
    SELECT series, 'y' AS variable, t, round(y, 4) AS value FROM r WHERE t >= {LO}""")  # fmt: skip
ask("mdl_forecast", lambda w: ms.simulate_frame(w.withColumn("y", F.when(F.col("__t") < LO, F.col("y"))), RECURSIVE, 12, RANGE, G, kind="FORECAST"), ORACLE["mdl_simulate_dynamic_recursive"][ORACLE["mdl_simulate_dynamic_recursive"].index("r(series"):])
LEADING = """MODEL
IDENTITY> y
EQ> y = 0.5*TSLEAD(y) + x
END"""
_ahead = f"""r(series, t, y) AS (SELECT series, t, y FROM wide WHERE t = {HI + 1} UNION ALL SELECT w.series, w.t, 0.5 * r.y + w.x FROM r JOIN wide w ON w.series = r.series AND w.t = r.t - 1 WHERE w.t >= {LO})
    SELECT series, 'y' AS variable, t, round(y, 4) AS value FROM r WHERE t <= {HI}"""
ask("mdl_forward_looking", lambda w: ms.simulate_frame(w, LEADING, 12, RANGE, G, **TIGHT), _ahead)
ask("mdl_forward_looking_newton", lambda w: ms.simulate_frame(w, LEADING, 12, RANGE, G, algorithm="NEWTON", **TIGHT), _ahead)

# y is 1 + 0.5 x, with steps so that residuals are not zero
_w = "(SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM wide)"
_data = f"q AS (SELECT series, t, x, CAST(k % 7 AS DOUBLE) AS z, 1 + 0.5 * x + 0.3 * (k % 7) + 0.1 * (k % 3) AS y, x + 0.2 * (k % 5) AS i FROM {_w})"


def sampled(w: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("series").orderBy("__t"))
    return w.select("series", "__t", "x", k.alias("k")).select("series", "__t", "x", (F.col("k") % 7).cast("double").alias("z"), (1 + 0.5 * F.col("x") + 0.3 * (F.col("k") % 7) + 0.1 * (F.col("k") % 3)).alias("y"), (F.col("x") + 0.2 * (F.col("k") % 5)).alias("i"))


SIMPLE = """MODEL
BEHAVIORAL> y
EQ> y = a + b*x
COEFF> a b
IV> 1
IV> i
END"""
ask("mdl_ols", lambda w: ms.estimate_frame(sampled(w), SIMPLE, 12, G).select("series", "coefficient", "estimate"),
    f"{_data} SELECT series, c AS coefficient, round(CASE c WHEN 'a' THEN regr_intercept(y, x) ELSE regr_slope(y, x) END, 4) AS estimate FROM q, (SELECT unnest(['a', 'b']) AS c) GROUP BY series, c")
ask("mdl_ols_stats", lambda w: ms.per_group(sampled(w), G, "ssr double, r_squared double, durbin_watson double, dof int", lambda d, _: pd.DataFrame([{k: getattr(e, k) for k in ("ssr", "r_squared", "durbin_watson", "dof")} for e in est.estimate(load_model(model_text=SIMPLE), d).values()]), 12),
    f"""{_data}, e AS (SELECT q.series, q.t, q.y - (f.a + f.b * q.x) AS e, q.y FROM q JOIN (SELECT series, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM q GROUP BY 1) f ON f.series = q.series),
    d AS (SELECT *, e - lag(e) OVER (PARTITION BY series ORDER BY t) AS de FROM e)
    SELECT series, round(sum(e * e), 4) AS ssr, round(1 - sum(e * e) / (count(*) * var_pop(y)), 4) AS r_squared, round(sum(de * de) / sum(e * e), 4) AS durbin_watson, CAST(count(*) - 2 AS INT) AS dof FROM d GROUP BY series""")  # fmt: skip
ask("mdl_iv", lambda w: ms.estimate_frame(sampled(w), SIMPLE, 12, G, method="IV").select("series", "coefficient", "estimate"),
    f"{_data} SELECT series, c AS coefficient, round(CASE c WHEN 'b' THEN covar_pop(i, y) / covar_pop(i, x) ELSE avg(y) - covar_pop(i, y) / covar_pop(i, x) * avg(x) END, 4) AS estimate FROM q, (SELECT unnest(['a', 'b']) AS c) GROUP BY series, c")


def _by_moments(w: DataFrame, zs: list[str]) -> DataFrame:
    q = sampled(w)
    found = est.from_moments(est.moments(q, "y", ["x"], zs), "y", ["x"], zs)
    return w.sparkSession.createDataFrame([(k, float(found[v])) for k, v in (("a", "1"), ("b", "x"))], "coefficient string, estimate double")


ask("mdl_ols_moments", lambda w: _by_moments(w, []), f"{_data} SELECT c AS coefficient, round(CASE c WHEN 'a' THEN regr_intercept(y, x) ELSE regr_slope(y, x) END, 4) AS estimate FROM q, (SELECT unnest(['a', 'b']) AS c) GROUP BY c")
ask("mdl_iv_moments", lambda w: _by_moments(w, ["i"]), f"{_data} SELECT c AS coefficient, round(CASE c WHEN 'b' THEN covar_pop(i, y) / covar_pop(i, x) ELSE avg(y) - covar_pop(i, y) / covar_pop(i, x) * avg(x) END, 4) AS estimate FROM q, (SELECT unnest(['a', 'b']) AS c) GROUP BY c")
RESTRICTED = """MODEL
BEHAVIORAL> y
EQ> y = b*x + g*z
COEFF> b g
RESTRICT> b + g = 1
END"""
ask("mdl_restricted", lambda w: ms.estimate_frame(sampled(w), RESTRICTED, 12, G).select("series", "coefficient", "estimate"),
    f"{_data} SELECT series, c AS coefficient, round(CASE c WHEN 'b' THEN sum((y - z) * (x - z)) / sum((x - z) * (x - z)) ELSE 1 - sum((y - z) * (x - z)) / sum((x - z) * (x - z)) END, 4) AS estimate FROM q, (SELECT unnest(['b', 'g']) AS c) GROUP BY series, c")
LAGGED = """MODEL
BEHAVIORAL> y
EQ> y = a + b*x
COEFF> a b
PDL> b 1 2
END"""
_det = "(var_pop(x) * var_pop(p) - covar_pop(x, p) * covar_pop(x, p))"
ask("mdl_pdl", lambda w: ms.estimate_frame(sampled(w), LAGGED, 12, G).select("series", "coefficient", "estimate"),
    f"""{_data}, u AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY t) AS p FROM q) WHERE p IS NOT NULL),
    f AS (SELECT series, avg(y) AS my, avg(x) AS mx, avg(p) AS mp, (covar_pop(x, y) * var_pop(p) - covar_pop(p, y) * covar_pop(x, p)) / {_det} AS b0, (covar_pop(p, y) * var_pop(x) - covar_pop(x, y) * covar_pop(x, p)) / {_det} AS b1 FROM u GROUP BY series)
    SELECT series, c AS coefficient, round(CASE c WHEN 'a' THEN my - b0 * mx - b1 * mp WHEN 'b__PDL__0' THEN b0 ELSE b1 END, 4) AS estimate FROM f, (SELECT unnest(['a', 'b__PDL__0', 'b__PDL__1']) AS c)""")  # fmt: skip
AUTO = """MODEL
BEHAVIORAL> y
EQ> y = a + b*x
COEFF> a b
ERROR> AUTO(1)
END"""
ask("mdl_ar", lambda w: ms.estimate_frame(sampled(w), AUTO, 12, G).select("series", "coefficient", "estimate"))


def _chow(data, _) -> pd.DataFrame:
    e = est.estimate(load_model(model_text=SIMPLE), data, time_range=((1995, 6), (1997, 12)), force_time_range=True, chow_test_=True, chow_end=(1998, 12))["y"]
    return pd.DataFrame([{"f": e.chow.f_statistic, "d1": e.chow.dof[0], "d2": e.chow.dof[1]}])


_ssr = lambda hi: f"(SELECT series, (count(*) * (var_pop(y) - covar_pop(x, y) * covar_pop(x, y) / var_pop(x))) AS s, count(*) - 2 AS d FROM q WHERE t BETWEEN {1995 * 12 + 5} AND {hi} GROUP BY series)"
ask("mdl_chow", lambda w: ms.per_group(sampled(w), G, "f double, d1 int, d2 int", _chow, 12),
    f"{_data} SELECT a.series, round((b.s / a.s - 1) * b.d / (b.d - a.d), 4) AS f, CAST(b.d - a.d AS INT) AS d1, CAST(b.d AS INT) AS d2 FROM {_ssr(1997 * 12 + 11)} a JOIN {_ssr(HI)} b ON a.series = b.series")

SHIFTS = np.array([[(r + 1) * (t + 1) / 10.0 for r in range(5)] for t in range(4)])
_draw = f"""r(series, t, k, y) AS (SELECT series, t, k, y FROM wide, (SELECT unnest(generate_series(1, 5)) AS k) WHERE t = {LO - 1}
    UNION ALL SELECT w.series, w.t, r.k, w.x + 0.5 * r.y + r.k * (w.t - {LO} + 1) / 10.0 FROM r JOIN wide w ON w.series = r.series AND w.t = r.t + 1 WHERE w.t <= {LO + 3})"""
ask("mdl_stochastic_matrix", lambda w: ms.replica_statistics(ms.stochastic_frame(w, RECURSIVE, 12, SHORT, {"y": sim.Disturbance("MATRIX", SHIFTS)}, G, replicas=5, seed=1), G),
    f"{_draw} SELECT series, 'y' AS variable, t, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS sd FROM r WHERE t >= {LO} GROUP BY 1, 2, 3")
ask("mdl_independent_replicas", lambda w: ms.independent_replicas(w.where("series = '1-URGENT'").drop("series"), RECURSIVE, 12, SHORT, {"y": sim.Disturbance("MATRIX", SHIFTS)}, replicas=5, seed=1, buckets=3),
    f"{_draw} SELECT 'y' AS variable, t, CAST(k AS INT) AS replica, round(y, 4) AS value FROM r WHERE t >= {LO} AND series = '1-URGENT'")
ask("mdl_multipliers", lambda w: ms.multiplier_frame(w, RECURSIVE, 12, SHORT, ["y"], ["x"], G),
    f"SELECT series, 'y' AS target, CAST(a AS BIGINT) AS response_t, 'x' AS instrument, CAST(b AS BIGINT) AS shock_t, round(CASE WHEN a >= b THEN pow(0.5, a - b) ELSE 0 END, 4) AS value FROM (SELECT DISTINCT series FROM wide), (SELECT unnest(generate_series({LO}, {LO + 3})) AS a), (SELECT unnest(generate_series({LO}, {LO + 3})) AS b)")
ask("mdl_renormalize", lambda w: ms.renormalize_frame(w, RECURSIVE, 12, SHORT, {"y": [10.0, 20.0, 30.0, 40.0]}, ["x"], G),
    f"SELECT series, 'x' AS variable, CAST(t AS BIGINT) AS t, round(10 * (t - {LO} + 1) - 0.5 * CASE WHEN t = {LO} THEN y ELSE 10 * (t - {LO}) END, 4) AS value FROM (SELECT series, y FROM wide WHERE t = {LO - 1}), (SELECT unnest(generate_series({LO}, {LO + 3})) AS t)")
ask("mdl_optimize", lambda w: ms.best_candidate(ms.optimize_frame(w, RECURSIVE, 12, ((1996, 1), (1996, 1)), {"x": sim.Bound(0.0, 10.0)}, [sim.Timed("-(x-3)^2")], [sim.Timed("x > 3")], G, replicas=200, seed=7), G).select("series", "__replica", "max", "feasible"))


def _rng(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("normal", i, float(v)) for i, v in enumerate(RStream(123).normal(0, 1, (10, 1))[:, 0])] + [("uniform", i, float(v)) for i, v in enumerate(RStream(1).uniform(0, 1, (10, 1))[:, 0])]
    return spark.createDataFrame(rows, "stream string, i int, value double")


QUERIES["rng_streams"] = lambda spark, sf: _rng(spark, sf).withColumn("value", F.round("value", 6))
# The first ten draws that R documents for set.seed(123); rnorm(10) and set.seed(1); runif(10).
_NORMAL = (-0.560476, -0.230177, 1.558708, 0.070508, 0.129288, 1.715065, 0.460916, -1.265061, -0.686853, -0.445662)
_UNIFORM = (0.265509, 0.372124, 0.572853, 0.908208, 0.201682, 0.898390, 0.944675, 0.660798, 0.629114, 0.061786)
ORACLE["rng_streams"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({i} AS INT), CAST({v} AS DOUBLE))" for n, vs in (("normal", _NORMAL), ("uniform", _UNIFORM)) for i, v in enumerate(vs)) + ") AS d(stream, i, value)"
