"""Data of a model on the driver or in a task: arrays of one calendar, and expressions over whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..functions import periods
from .expr import Binary, Call, Expression, MdlError, Number, Unary, Variable, lowered, source

Yp = tuple[int, int]


@dataclass
class Data:
    """Variables as arrays from ordinal t0 on; NaN is missing; bounds are the first and last ordinal of each."""

    freq: int
    t0: int
    arrays: dict[str, np.ndarray]
    bounds: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, series: dict[str, tuple[Yp, list]], freq: int) -> Data:
        """From {name: ((year, period), values)}."""
        starts = {n: periods.ordinal(*s, freq) for n, (s, _) in series.items()}
        lo, hi = min(starts.values()), max(starts[n] + len(v) - 1 for n, (_, v) in series.items())
        arrays, bounds = {}, {}
        for n, (_, v) in series.items():
            a = np.full(hi - lo + 1, np.nan)
            own = np.array([np.nan if x is None else x for x in v], dtype=float)
            a[starts[n] - lo : starts[n] - lo + len(own)] = own
            arrays[n], bounds[n] = a, (starts[n], starts[n] + len(own) - 1)
        return cls(freq, lo, arrays, bounds)

    @classmethod
    def from_wide(cls, pdf: pd.DataFrame, freq: int, t: str = "__t") -> Data:
        """From a frame with a column of ordinals and one for each variable; its rows may come in any order."""
        pdf = pdf.sort_values(t)
        ts = pdf[t].to_numpy(dtype=np.int64)
        lo, hi = int(ts[0]), int(ts[-1])
        arrays = {}
        for c in pdf.columns:
            if c != t and pd.api.types.is_numeric_dtype(pdf[c]):
                a = np.full(hi - lo + 1, np.nan)
                a[ts - lo] = pdf[c].to_numpy(dtype=float)
                arrays[c] = a
        return cls(freq, lo, arrays, dict.fromkeys(arrays, (lo, hi)))

    @classmethod
    def of_frame(cls, frame) -> Data:
        """From a TsFrame whose series are the variables of one model: a model's data, a few thousand numbers."""
        rows = frame.df.toPandas()
        series = {}
        for name, own in rows.groupby("__series"):
            own = own.sort_values("__t")
            series[name] = (periods.year_period(int(own["__t"].iloc[0]), frame.freq), own["value"].tolist())
        return cls.of(series, frame.freq)

    def ordinal(self, yp: Yp | int) -> int:
        return yp if isinstance(yp, (int, np.integer)) else periods.ordinal(*yp, self.freq)

    @property
    def end(self) -> int:
        return self.t0 + len(next(iter(self.arrays.values()))) - 1

    def value(self, name: str, t: int) -> float:
        i = t - self.t0
        return float(self.arrays[name][i]) if 0 <= i < len(self.arrays[name]) else float("nan")

    def window(self, name: str, lo: int, hi: int) -> np.ndarray:
        """Values of lo..hi, NaN outside."""
        out = np.full(hi - lo + 1, np.nan)
        a, b = max(lo, self.t0), min(hi, self.end)
        if a <= b:
            out[a - lo : b - lo + 1] = self.arrays[name][a - self.t0 : b - self.t0 + 1]
        return out

    def need(self, names) -> None:
        gone = [n for n in names if n not in self.arrays]
        if gone:
            raise KeyError(f"no data for {gone}")


def div_(a, b):
    with np.errstate(all="ignore"):
        return np.divide(a, b)


def pow_(a, b):
    with np.errstate(all="ignore"):
        return np.power(np.asarray(a, dtype=float), b)


def log_(a):
    with np.errstate(all="ignore"):
        return np.log(a)


def exp_(a):
    with np.errstate(all="ignore"):
        return np.exp(a)


HELPERS = {"div_": div_, "pow_": pow_, "log_": log_, "exp_": exp_, "abs_": np.abs, "__builtins__": {}}


def expression_range(e: Expression, data: Data) -> tuple[int, int] | None:
    """Range on which an expression has values: what its shifted variables share; None for one without variables."""
    ends = []

    def see(x: Expression) -> None:
        if isinstance(x, Variable):
            data.need([x.name])
            ends.append((data.bounds[x.name][0] - x.offset, data.bounds[x.name][1] - x.offset))
        elif isinstance(x, Binary):
            see(x.left)
            see(x.right)
        elif isinstance(x, (Unary, Call)):
            see(x.arg)

    see(lowered(e))
    if not ends:
        return None
    lo, hi = max(a for a, _ in ends), min(b for _, b in ends)
    if lo > hi:
        raise MdlError("the variables of an expression share no period")
    return lo, hi


def evaluate_on(e: Expression, data: Data, lo: int, hi: int) -> np.ndarray:
    """Values of an expression on lo..hi."""
    low, used = lowered(e), {}

    def leaf(name: str, offset: int) -> str:
        key = f"v{len(used)}_" if (name, offset) not in used else used[name, offset][0]
        used.setdefault((name, offset), (key, data.window(name, lo + offset, hi + offset)))
        return key

    text = source(low, leaf)
    scope = HELPERS | {k: v for k, v in used.values()}
    with np.errstate(all="ignore"):
        out = eval(compile(text, "<expression>", "eval"), scope)  # noqa: S307  source is made from the tree, never from the model's text
    return np.broadcast_to(np.asarray(out), (hi - lo + 1,))


def evaluate_expression(e: Expression, data: Data) -> tuple[int, np.ndarray] | float:
    """(first ordinal, values) of an expression over its own range, or the number it is."""
    r = expression_range(e, data)
    if r is None:
        return float(evaluate_on(e, data, 0, 0)[0]) if not isinstance(e, Number) else e.value
    return r[0], evaluate_on(e, data, *r)
