"""Estimation of behavioural equations: least squares, instrumental variables, restrictions, polynomial lags, autoregressive errors.

The algebra works on the design of one equation, which has as many rows as periods. Where a design has more rows than a task should hold,
`moments` gives the cross products by one native aggregate and `from_moments` the same least-squares result from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods
from .data import Data, evaluate_on, expression_range
from .expr import Call, Expression, MdlError, Variable, parse_expression, variable_names
from .parse import Behavioral, Model
from .probability import f_survival, t_two_sided

Yp = tuple[int, int]


@dataclass
class ChowTest:
    f_statistic: float
    f_probability: float
    dof: tuple[int, int]
    start: int
    actual: np.ndarray
    predicted: np.ndarray
    standard_errors: np.ndarray

    @property
    def errors(self) -> np.ndarray:
        return self.actual - self.predicted

    def summary(self) -> pd.DataFrame:
        return pd.DataFrame({"t": np.arange(self.start, self.start + len(self.actual)), "actual": self.actual, "predicted": self.predicted, "error": self.errors, "standard_error": self.standard_errors, "t_statistic": self.errors / self.standard_errors})


@dataclass
class EquationEstimate:
    name: str
    method: str
    names: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    factor: np.ndarray
    start: int
    end: int
    residuals: np.ndarray
    fitted: np.ndarray
    dependent: np.ndarray
    design: np.ndarray
    dof: int
    facts: dict[str, float]
    rho: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rho_errors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    iterations: int = 0
    chow: ChowTest | None = None

    def __getattr__(self, name: str) -> float:
        try:
            return self.__dict__["facts"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist()))

    @property
    def errors(self) -> np.ndarray:
        return np.sqrt(np.abs(np.diag(self.covariance)))

    def all_coefficients(self) -> dict[str, float]:
        return self.coefficients | {f"RHO_{i}": float(r) for i, r in enumerate(self.rho, 1)}

    def summary(self) -> pd.DataFrame:
        """equation, coefficient, estimate, std_error, t_statistic and p_value of each, autoregressive ones last."""
        names = [*self.names, *(f"RHO_{i}" for i in range(1, len(self.rho) + 1))]
        beta, errors = np.concatenate([self.beta, self.rho]), np.concatenate([self.errors, self.rho_errors])
        with np.errstate(all="ignore"):
            t = beta / errors
        return pd.DataFrame({"equation": self.name, "coefficient": names, "estimate": beta, "std_error": errors, "t_statistic": t, "p_value": [t_two_sided(x, self.dof) for x in t]})


class Estimates(dict):
    """EquationEstimate by equation."""

    def summary(self) -> pd.DataFrame:
        return pd.concat([e.summary() for e in self.values()], ignore_index=True)


def _invertible(m: np.ndarray, tol: float) -> None:
    s = np.linalg.svd(m, compute_uv=False)
    if not len(s) or s[-1] <= tol * s[0]:
        raise np.linalg.LinAlgError("singular")


def _fit(y, x, z, r, q, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance factor) of least squares under r b = q, on x projected on z where there are instruments."""
    used = x
    if z is not None:
        zz = z.T @ z
        _invertible(zz, tol)
        used = z @ np.linalg.solve(zz, z.T @ x)
    if not len(q):
        xx = used.T @ used
        _invertible(xx, tol)
        return np.linalg.solve(xx, used.T @ y), np.linalg.inv(xx)
    _, s, vt = np.linalg.svd(r)
    if len(s) < len(q) or s[-1] <= tol * s[0]:
        raise MdlError("the restrictions depend on each other")
    base, *_ = np.linalg.lstsq(r, q, rcond=tol)
    free = vt[len(q) :].T
    if not free.shape[1]:
        return base, np.zeros((len(base), len(base)))
    reduced = used @ free
    rr = reduced.T @ reduced
    _invertible(rr, tol)
    alpha, *_ = np.linalg.lstsq(reduced, y - used @ base, rcond=None)
    return base + free @ alpha, free @ np.linalg.inv(rr) @ free.T


def _rho(e: np.ndarray, order: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([e[order - k : len(e) - k] for k in range(1, order + 1)])
    xx = x.T @ x
    _invertible(xx, tol)
    rho = np.linalg.solve(xx, x.T @ e[order:])
    return rho, np.linalg.inv(xx), e[order:] - x @ rho


def _ar(v: np.ndarray, rho: np.ndarray) -> np.ndarray:
    n = len(rho)
    return v[n:] - sum(r * v[n - k : len(v) - k] for k, r in enumerate(rho, 1))


def _restrictions(b: Behavioral, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the user's restrictions, then those that make polynomial lags: differences of order degree + 1 vanish, ends if asked."""
    rows, targets = [], []
    lengths = {p.coefficient: p.length for p in b.pdls}
    for r in b.restrictions:
        row = np.zeros(len(names))
        for m, c, k in r.terms:
            row[names.index(f"{c}__PDL__{k or 0}" if c in lengths else c)] = m
        rows.append(row)
        targets.append(r.value)
    for p in b.pdls:
        at = names.index(f"{p.coefficient}__PDL__0")
        d = p.degree + 1
        for i in range(p.length - d):
            row = np.zeros(len(names))
            for j in range(d + 1):
                row[at + i + j] = (-1) ** j * math.comb(d, j)
            rows.append(row)
        for flag, k in ((p.near, 0), (p.far, p.length - 1)):
            if flag:
                row = np.zeros(len(names))
                row[at + k] = 1.0
                rows.append(row)
    targets += [0.0] * (len(rows) - len(targets))
    return np.array(rows).reshape(-1, len(names)), np.array(targets)


def dependent_expression(b: Behavioral) -> Expression:
    e = b.equation
    return Variable(e.dependent) if e.function == "IDENTITY" else Call(e.function, Variable(e.dependent), e.periods)


def _sample(b: Behavioral, data: Data, lag_of: list[tuple[str, Expression, int]], time_range, force: bool) -> tuple[int, int]:
    if b.time_range is not None and not force:
        return data.ordinal(b.time_range.start), data.ordinal(b.time_range.end)
    if time_range is not None:
        return data.ordinal(time_range[0]), data.ordinal(time_range[1])
    ends = [expression_range(dependent_expression(b), data)] + [(r[0] + k, r[1] + k) for _, e, k in lag_of if (r := expression_range(e, data))]
    lo, hi = max(a for a, _ in ends) + b.error_order, min(z for _, z in ends)
    if lo > hi:
        raise MdlError(f"{b.name}: no common sample")
    return lo, hi


def estimate_equation(b: Behavioral, data: Data, *, method: str = "OLS", instruments=None, center_covariance: bool = True, time_range=None, force_time_range: bool = False, tol: float = 1e-12) -> EquationEstimate:
    method = method.upper()
    if method not in ("OLS", "IV"):
        raise ValueError(f"unknown method: {method}")
    terms, n_ar = b.terms(), b.error_order
    names = [c for c, _, _ in terms]
    lo, hi = _sample(b, data, terms, time_range, force_time_range)
    first = lo - n_ar
    y = evaluate_on(dependent_expression(b), data, first, hi).astype(float)
    x = np.column_stack([evaluate_on(e, data, first - k, hi - k) for _, e, k in terms]).astype(float)
    z = None
    if method == "IV":
        own = [parse_expression(i) if isinstance(i, str) else i for i in (instruments if instruments is not None else b.instruments)]
        if not own:
            raise MdlError(f"{b.name}: no instruments")
        z = np.column_stack([evaluate_on(e, data, first, hi) for e in own]).astype(float)
    if not all(np.isfinite(a).all() for a in (y, x, *(() if z is None else (z,)))):
        raise MdlError(f"{b.name}: missing or infinite values in the sample")
    r, q = _restrictions(b, names)
    n, k = hi - lo + 1, len(names)
    dof = n - k + len(q) - n_ar
    if dof <= 0:
        raise MdlError(f"{b.name}: no degrees of freedom")
    try:
        beta, factor = _fit(y, x, z, r, q, tol)
        rho, rho_factor, innovations, iterations, yy, xx, zz = np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0, y, x, z
        if n_ar:
            zz = None if z is None else z[n_ar:]
            rho, rho_factor, innovations = _rho(y - x @ beta, n_ar, tol)
            settled = False
            for iterations in range(2, 21):  # once the autoregression has settled, one more fit
                yy, xx = _ar(y, rho), _ar(x, rho)
                beta, factor = _fit(yy, xx, zz, r, q, tol)
                if settled:
                    break
                new, rho_factor, innovations = _rho(y - x @ beta, n_ar, tol)
                settled = bool(np.all(np.abs(new - rho) < 0.005))
                rho = new
            else:
                yy, xx = _ar(y, rho), _ar(x, rho)
    except np.linalg.LinAlgError:
        raise MdlError(f"{b.name}: the regressors depend on each other") from None
    e = yy - xx @ beta
    own_y, own_x = y[n_ar:], x[n_ar:]
    ssr = float(e @ e)
    se = math.sqrt(max(ssr - e.sum() ** 2 / n, 0.0) / dof)
    se_plain = math.sqrt(ssr / dof)
    scale = (se if center_covariance else se_plain) ** 2
    constant = any(not variable_names(t) for _, t, _ in terms)
    mean = float(own_y.mean()) if constant else 0.0
    tss = float((own_y - mean) @ (own_y - mean))
    r2 = 1 - ssr / tss if tss else math.nan
    spent = n - dof
    log_likelihood = -n / 2 * (math.log(2 * math.pi) + 1 + math.log(ssr / n)) if ssr > 0 else math.inf
    slopes = spent - constant
    f = r2 / (1 - r2) * dof / slopes if slopes > 0 and 0 <= r2 < 1 else math.nan
    facts = {
        "ssr": ssr, "standard_error": se, "standard_error_not_centered": se_plain, "r_squared": r2,
        "adjusted_r_squared": 1 - (1 - r2) * (n - 1 if constant or n_ar or len(q) else n) / dof,
        "log_likelihood": log_likelihood, "f_statistic": f, "f_probability": f_survival(f, slopes, dof),
        "aic": -2 * log_likelihood + 2 * (spent + 1), "bic": -2 * log_likelihood + math.log(n) * (spent + 1),
        "durbin_watson": float(np.diff(e) @ np.diff(e)) / ssr if ssr > 0 else math.nan, "observations": n,
    }
    if len(q):
        free, _ = _fit(yy, xx, None if z is None else zz, np.zeros((0, k)), np.zeros(0), tol) if _full_rank(xx, tol) else (None, None)
        if free is not None:
            u = yy - xx @ free
            ssu, below = float(u @ u), n - k - n_ar
            rf = ((ssr - ssu) / len(q)) / (ssu / below) if below > 0 and ssu > 0 else math.inf
            facts |= {"restriction_f": rf, "restriction_probability": f_survival(rf, len(q), n - k)}
    rho_errors = np.zeros(0)
    if n_ar:
        ss = float(innovations @ innovations)
        rho_scale = (max(ss - innovations.sum() ** 2 / n, 0.0) if center_covariance else ss) / dof
        rho_errors = np.sqrt(np.abs(np.diag(rho_scale * rho_factor)))
    return EquationEstimate(b.name, method, tuple(names), beta, scale * factor, factor, lo, hi, e, own_x @ beta, own_y, own_x, dof, facts, rho, rho_errors, iterations)


def _full_rank(x: np.ndarray, tol: float) -> bool:
    try:
        _invertible(x.T @ x, tol)
    except np.linalg.LinAlgError:
        return False
    return True


def chow_test(b: Behavioral, data: Data, base: EquationEstimate, chow_end: Yp | None, **how) -> ChowTest:
    """Stability of the coefficients beyond the sample, up to chow_end or the last period that data allow."""
    if chow_end is None:
        own = [parse_expression(i) if isinstance(i, str) else i for i in (how.get("instruments") or b.instruments)] if base.method == "IV" else []
        ends = [expression_range(e, data) for e in (dependent_expression(b), *(t for t in b.regressors), *own)]
        last = min(r[1] for r in ends if r)
    else:
        last = data.ordinal(chow_end)
    if last <= base.end:
        raise MdlError(f"{b.name}: nothing beyond the sample to test")
    span = (periods.year_period(base.start, data.freq), periods.year_period(last, data.freq))
    more = estimate_equation(b, data, **(how | {"time_range": span, "force_time_range": True}))
    d1 = more.dof - base.dof
    f = (more.ssr / base.ssr - 1) * more.dof / d1
    x, y = more.design[base.observations :], more.dependent[base.observations :]
    spread = np.einsum("ij,jk,ik->i", x, base.factor, x)
    return ChowTest(f, f_survival(f, d1, more.dof), (d1, more.dof), base.end + 1, y, x @ base.beta, base.standard_error * np.sqrt(np.maximum(1 + spread, 0)))


def estimate(model: Model, data: Data, *, equations: list[str] | None = None, chow_test_: bool = False, chow_end: Yp | None = None, **how) -> Estimates:
    """Estimates of the named equations, or all."""
    out = Estimates()
    for name in equations or list(model.behaviorals):
        if name not in model.behaviorals:
            raise KeyError(name)
        data.need({v for e in (*model.behaviorals[name].regressors, *model.behaviorals[name].instruments) for v in variable_names(e)} | {name})
        out[name] = estimate_equation(model.behaviorals[name], data, **how)
        if chow_test_:
            out[name].chow = chow_test(model.behaviorals[name], data, out[name], chow_end, **how)
    return out


# ---- large designs, by Spark


def moments(df: DataFrame, y: str, xs: list[str], zs: list[str] = ()) -> dict[tuple[str, str], float]:
    """Sums of products of all pairs of the named columns (and '1'), by one aggregate with map-side combining; rows with nulls don't count."""
    names = list(dict.fromkeys([y, *xs, *zs]))
    whole = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.where(whole).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names)]).first()
    out = {("1", "1"): float(row["n"])}
    for i, (a, b) in enumerate(pairs):
        out[a, b] = out[b, a] = row[f"p{i}"] or 0.0
    for i, n in enumerate(names):
        out[n, "1"] = out["1", n] = row[f"s{i}"] or 0.0
    return out


def from_moments(m: dict[tuple[str, str], float], y: str, xs: list[str], zs: list[str] = ()) -> dict[str, float]:
    """Coefficients by name ('1' is the intercept), with instruments zs where given, and ssr, r_squared, dof."""
    xs, zs = ["1", *xs], ["1", *zs] if zs else []
    block = lambda a, b: np.array([[m[i, j] for j in b] for i in a])
    xx, xy = block(xs, xs), block(xs, [y])[:, 0]
    if zs:
        zx, zz, zy = block(zs, xs), block(zs, zs), block(zs, [y])[:, 0]
        beta = np.linalg.solve(zx.T @ np.linalg.solve(zz, zx), zx.T @ np.linalg.solve(zz, zy))
    else:
        beta = np.linalg.solve(xx, xy)
    n = m["1", "1"]
    ssr = float(m[y, y] - 2 * beta @ xy + beta @ xx @ beta)
    tss = m[y, y] - m[y, "1"] ** 2 / n
    return dict(zip(xs, beta.tolist())) | {"ssr": ssr, "r_squared": 1 - ssr / tss, "dof": n - len(xs)}
