"""Simulation kernel: block order, compiled equations, Gauss-Seidel, Newton, and stacked time, on matrices (periods x replicas).

A plain simulation is one replica. Equations are compiled from their trees to NumPy expressions over four views of the state: C (this
period), L (earlier periods), D (later periods) and A (add-factors). Which matrices stand behind C, L and D makes the kinds of simulation:
dynamic C = L = the solution, static L = history, residual check C = L = D = history.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions import periods
from .data import HELPERS, Data
from .expr import Expression, MdlError, lowered, shifted, source
from .parse import Behavioral, Equation, Model

Yp = tuple[int, int]
KINDS = ("DYNAMIC", "STATIC", "FORECAST", "RESCHECK")
ALGORITHMS = ("GAUSS-SEIDEL", "NEWTON", "FULLNEWTON")
RATES = {"NEWTON": (0.9, 0.75), "FULLNEWTON": (0.6, 0.45)}  # of convergence: beyond them the Jacobian is rebuilt, the step is shortened


class ConvergenceError(MdlError):
    """A system has not converged."""


@dataclass(frozen=True)
class Block:
    variables: tuple[str, ...]
    simultaneous: bool
    feedback: tuple[str, ...] = ()


# ---- order


def _components(names: tuple[str, ...], needs: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """Strongly connected components, those needed first (Tarjan, without recursion)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, out = set(), [], []
    for root in names:
        if root in index:
            continue
        work = [(root, iter(needs[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(needs[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(part)
    return out


def _feedback(part: list[str], needs: dict[str, tuple[str, ...]]) -> list[str]:
    """Variables without which the rest of a cyclic component can be put in order, by reduction of its graph."""
    into = {n: {m for m in needs[n] if m in part} for n in part}
    onto = {n: {m for m in part if n in into[m]} for n in part}
    cut: list[str] = []

    def remove(n: str) -> None:
        for m in into.pop(n):
            onto[m].discard(n) if m != n else None
        for m in onto.pop(n):
            if m != n and m in into:
                into[m].discard(n)

    def bypass(n: str) -> None:
        a, b = set(into[n]), set(onto[n])
        remove(n)
        for m in a:
            for k in b:
                onto[m].add(k)
                into[k].add(m)

    while into:
        for n in list(into):
            if n in into[n]:
                cut.append(n)
                remove(n)
                break
            if not into[n] or not onto[n]:
                remove(n)
                break
            if len(into[n]) == 1 or len(onto[n]) == 1:
                bypass(n)
                break
        else:
            n = max(into, key=lambda x: len(into[x]) * len(onto[x]))
            cut.append(n)
            remove(n)
    return [n for n in part if n in cut]


def blocks(model: Model) -> list[Block]:
    """Blocks in the order of solution; within a simultaneous one the feedback variables come last."""
    needs, place = model.dependencies, {n: i for i, n in enumerate(model.endogenous)}
    out = []
    for part in _components(model.endogenous, needs):
        part = sorted(part, key=place.__getitem__)
        if len(part) == 1 and part[0] not in needs[part[0]]:
            out.append(Block((part[0],), False))
            continue
        cut = _feedback(part, needs)
        done, order, rest = set(cut), [], [n for n in part if n not in cut]
        while rest:
            n = next(x for x in rest if all(m in done or m not in part for m in needs[x]))
            order.append(n)
            done.add(n)
            rest.remove(n)
        out.append(Block((*order, *cut), True, tuple(cut)))
    return out


# ---- compiled equations


def _scope() -> dict:
    return HELPERS | {"where_": np.where}


class Compiled:
    """Equations of a model with coefficients, as functions of (C, L, D, A, p)."""

    def __init__(self, model: Model, coefficients: dict[str, dict[str, float]], zero_ar: bool = False) -> None:
        self.model, self.coefficients, self.zero_ar = model, coefficients, zero_ar
        self.names = (*model.endogenous, *model.exogenous)
        self.at = {n: i for i, n in enumerate(self.names)}
        self.solve: dict[str, Callable] = {}
        self.rhs: dict[str, Callable] = {}
        self.lhs: dict[str, Callable] = {}
        for n in model.endogenous:
            rhs, inverse, lhs = self._behavioral(model.behaviorals[n]) if n in model.behaviorals else self._identity(n)
            for where, text in ((self.rhs, rhs), (self.solve, inverse), (self.lhs, lhs)):
                where[n] = eval(compile(f"lambda C, L, D, A, p: {text}", f"<{n}>", "eval"), _scope())  # noqa: S307  made from trees

    def leaf(self, name: str, offset: int) -> str:
        i = self.at[name]
        return f"C[{i}][p]" if offset == 0 else f"{'L' if offset < 0 else 'D'}[{i}][p{offset:+d}]"

    def text(self, e: Expression, shift: int = 0) -> str:
        return source(shifted(lowered(e), shift), self.leaf)

    def _lhs(self, e: Equation, shift: int = 0) -> str:
        y = lambda k: self.leaf(e.dependent, shift - k)
        n = e.periods
        return {"IDENTITY": y(0), "LOG": f"log_({y(0)})", "EXP": f"exp_({y(0)})", "TSDELTA": f"({y(0)} - {y(n)})", "TSDELTALOG": f"(log_({y(0)}) - log_({y(n)}))", "TSDELTAP": f"(100.0 * (div_({y(0)}, {y(n)}) - 1.0))"}[e.function]

    def _inverse(self, e: Equation, rhs: str) -> str:
        y = self.leaf(e.dependent, -e.periods)
        return {"IDENTITY": rhs, "LOG": f"exp_({rhs})", "EXP": f"log_({rhs})", "TSDELTA": f"({y} + {rhs})", "TSDELTALOG": f"exp_(log_({y}) + {rhs})", "TSDELTAP": f"({y} * (1.0 + ({rhs}) / 100.0))"}[e.function]

    def _behavioral(self, b: Behavioral) -> tuple[str, str, str]:
        own = self.coefficients.get(b.name)
        if own is None:
            raise KeyError(f"no coefficients for {b.name}")

        def base(shift: int) -> str:
            parts = []
            for c, e, k in b.terms():
                if c not in own:
                    raise KeyError(f"{b.name}: no coefficient {c}")
                parts.append(f"{own[c]!r} * {self.text(e, shift - k)}")
            return "(" + " + ".join(parts) + ")"

        i, text = self.at[b.name], base(0)
        if b.error_order and not self.zero_ar:
            for k in range(1, b.error_order + 1):
                if f"RHO_{k}" not in own:
                    raise KeyError(f"{b.name}: no coefficient RHO_{k}")
                text += f" + {own[f'RHO_{k}']!r} * ({self._lhs(b.equation, -k)} - {base(-k)} - A[{i}][p-{k}])"
        rhs = f"({text} + A[{i}][p])"
        return rhs, self._inverse(b.equation, rhs), self._lhs(b.equation)

    def _identity(self, n: str) -> tuple[str, str, str]:
        i, own = self.at[n], self.model.identities[n]
        keep, first = self.leaf(n, 0), own.alternatives[0][1]
        solve = keep if own.conditional else ""
        rhs = self._lhs(first) if own.conditional else ""
        for condition, e in reversed(own.alternatives):
            r = f"({self.text(e.rhs)} + A[{i}][p])"
            if condition is None:
                solve, rhs = self._inverse(e, r), r
            else:
                c = self.text(condition)
                solve, rhs = f"where_({c}, {self._inverse(e, r)}, {solve})", f"where_({c}, {r}, {rhs})"
        return rhs, solve, self._lhs(first)


# ---- simulation


@dataclass
class Exogenization:
    """Ordinals first..last on which a variable keeps given values (an array from first on), or its data."""

    first: int
    last: int
    values: np.ndarray | None = None


@dataclass
class Run:
    kind: str
    start: int
    end: int
    freq: int
    t0: int
    names: tuple[str, ...]
    X: list[np.ndarray]
    iterations: dict[int, int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    add_factors: dict[str, np.ndarray] = field(default_factory=dict)

    def values(self, name: str, backfill: int = 0) -> np.ndarray:
        """(periods, replicas) of start..end, with `backfill` earlier periods."""
        i = self.names.index(name)
        return self.X[i][self.start - backfill - self.t0 : self.end - self.t0 + 1]


@dataclass
class Options:
    kind: str = "DYNAMIC"
    algorithm: str = "GAUSS-SEIDEL"
    convergence: float = 0.01
    max_iterations: int = 100
    jacobian_step: float = 1e-4
    jacobian_drop: tuple[str, ...] = ()
    retain: bool = False  # keep the last iteration, with a warning, where a system has not converged


DENSE = 400  # unknowns up to which one dense matrix is as fast


def dense(n: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    J = np.zeros((n, n))
    J[rows, columns] = values
    return J


class Banded:
    """Jacobian of a system stacked by periods: blocks of a period's equations by a period's unknowns, near the diagonal only.

    Factored by eliminating period after period with pivots inside a period's block, so memory and work grow with the number of periods,
    not its square and cube. Solutions are refined once; where a block is singular, or what is left over is too large, the
    dense matrix is solved instead.
    """

    def __init__(self, at: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        if (np.diff(at) < 0).any():
            raise ValueError("unknowns are stacked by periods")
        self.entries, self.n = (rows, columns, values), len(at)
        _, first, block = np.unique(at, return_index=True, return_inverse=True)
        self.ends = [*first.tolist(), len(at)]
        self.blocks: dict[tuple[int, int], np.ndarray] = {}
        bi, bj = block[rows], block[columns]
        pairs, which = np.unique(np.stack([bi, bj], 1), axis=0, return_inverse=True) if len(rows) else (np.zeros((0, 2), int), np.zeros(0, int))
        for k, (i, j) in enumerate(pairs.tolist()):
            own = which.ravel() == k
            m = self.blocks[i, j] = np.zeros((self.ends[i + 1] - self.ends[i], self.ends[j + 1] - self.ends[j]))
            m[rows[own] - self.ends[i], columns[own] - self.ends[j]] = values[own]
        self.factors: list | None = None

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for (i, j), m in self.blocks.items():
            out[self.ends[i] : self.ends[i + 1]] += m @ x[self.ends[j] : self.ends[j + 1]]
        return out

    def factor(self) -> list:
        """Of each period: inverse of its pivot block, blocks to its right (premultiplied), blocks below."""
        left = dict(self.blocks)
        below: dict[int, list[int]] = {}
        right: dict[int, set[int]] = {}
        for i, j in left:
            if i > j:
                below.setdefault(j, []).append(i)
            elif j > i:
                right.setdefault(i, set()).add(j)
        out = []
        for t in range(len(self.ends) - 1):
            if (t, t) not in left:
                raise np.linalg.LinAlgError("empty block")
            inverse = np.linalg.inv(left.pop((t, t)))
            up = {j: inverse @ left.pop((t, j)) for j in sorted(right.get(t, ()))}
            down = {i: left.pop((i, t)) for i in sorted(set(below.get(t, ())))}
            for i, m in down.items():
                for j, u in up.items():
                    made = m @ u
                    left[i, j] = left[i, j] - made if (i, j) in left else -made
                    if j > i:
                        right.setdefault(i, set()).add(j)
                    elif i > j:
                        below.setdefault(j, []).append(i)
            out.append((inverse, up, down))
        return out

    def _once(self, b: np.ndarray) -> np.ndarray:
        part = lambda x, t: x[self.ends[t] : self.ends[t + 1]]
        y, x = b.copy(), np.empty_like(b)
        for t, (inverse, _, down) in enumerate(self.factors):
            part(y, t)[:] = inverse @ part(y, t)
            for i, m in down.items():
                part(y, i)[:] -= m @ part(y, t)
        for t in range(len(self.factors) - 1, -1, -1):
            part(x, t)[:] = part(y, t)
            for j, u in self.factors[t][1].items():
                part(x, t)[:] -= u @ part(x, j)
        return x

    def solve(self, b: np.ndarray) -> np.ndarray:
        try:
            if self.factors is None:
                self.factors = self.factor()
            x = self._once(b)
            x = x + self._once(b - self.times(x))
            if np.all(np.abs(b - self.times(x)) <= 1e-9 * (1 + np.abs(b).max(axis=0))):
                return x
        except np.linalg.LinAlgError:
            pass
        return np.linalg.solve(dense(self.n, *self.entries), b)


class Solver:
    """Solves a compiled model on matrices; `jacobians` keeps those of a baseline for its replicas."""

    def __init__(self, compiled: Compiled, data: Data, start: int, end: int, o: Options, *, replicas: int = 1, adjust=None, fixed=None, changes=None, jacobians=None) -> None:
        self.m, self.o, self.c = compiled.model, o, compiled
        if o.kind not in KINDS or o.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown simulation: {o.kind}, {o.algorithm}")
        if start > end:
            raise ValueError("the range is reversed")
        data.need(compiled.names)
        self.start, self.end, self.R = start, end, replicas
        lag, lead = max(self.m.max_lag, 1), self.m.max_lead
        self.t0, self.freq = start - lag, data.freq
        T = end + lead - self.t0 + 1
        self.H = [np.repeat(data.window(n, self.t0, end + lead)[:, None], replicas, axis=1) for n in compiled.names]
        self.A = [np.zeros((T, replicas)) for _ in compiled.names]
        self.fixed: dict[str, Exogenization] = fixed or {}
        for n, v in (adjust or {}).items():
            if n not in self.m.endogenous:
                raise KeyError(f"{n} is not endogenous")
            self.A[compiled.at[n]] += np.reshape(v, (T, -1)) if isinstance(v, np.ndarray) else v
        for n, f in (changes or {}).items():  # f(matrix, first row) changes an exogenous variable's or an add-factor's matrix in place
            i = compiled.at[n]
            f(self.A[i] if n in self.m.endogenous else self.H[i], start - self.t0)
        self.jacobians, self.store = jacobians, {}
        self.endogenous = [compiled.at[n] for n in self.m.endogenous]
        self.X = [h.copy() for h in self.H]
        self.forward = self.m.max_lead > 0
        gone = set(o.jacobian_drop) - set(self.m.endogenous)
        if gone:
            warnings.warn(f"not endogenous, ignored: {sorted(gone)}", RuntimeWarning, stacklevel=3)

    def row(self, t: int) -> int:
        return t - self.t0

    def is_fixed(self, n: str, t: int) -> bool:
        f = self.fixed.get(n)
        return f is not None and f.first <= t <= f.last

    def put_fixed(self, n: str, t: int) -> None:
        f, i = self.fixed[n], self.c.at[n]
        self.X[i][self.row(t)] = self.H[i][self.row(t)] if f.values is None else f.values[t - f.first]
        if not np.isfinite(self.X[i][self.row(t)]).all():
            raise MdlError(f"{n} has no value to keep at {periods.year_period(t, self.freq)}")

    def value(self, n: str, p) -> np.ndarray:
        X = self.X
        with np.errstate(all="ignore"):
            v = self.c.solve[n](X, self.H if self.o.kind == "STATIC" else X, X, self.A, p)
        return v

    def assign(self, n: str, p: int) -> None:
        v = self.value(n, p)
        if not np.isfinite(v).all():
            raise MdlError(f"{n} is not finite at {periods.year_period(p + self.t0, self.freq)}")
        self.X[self.c.at[n]][p] = v

    def run(self) -> Run:
        if self.o.kind == "RESCHECK":
            return self.residual_check()
        if self.forward:
            if self.o.kind != "DYNAMIC":
                raise ValueError("models with leads are simulated dynamically")
            return self.run_forward()
        for i in self.endogenous:  # beyond the data the last value goes on, as a start
            h = self.X[i]
            for p in range(self.row(self.start), len(h)):
                h[p] = np.where(np.isfinite(h[p]), h[p], h[p - 1])
        out = Run(self.o.kind, self.start, self.end, self.freq, self.t0, self.c.names, self.X, blocks=blocks(self.m))
        for t in range(self.start, self.end + 1):
            self.begin(t)
            most = 1
            for b in out.blocks:
                active = tuple(n for n in b.variables if not self.is_fixed(n, t))
                if not b.simultaneous:
                    for n in active:
                        self.assign(n, self.row(t))
                elif active:
                    most = max(most, self.block(b, active, t))
            out.iterations[t] = most
        return out

    def begin(self, t: int) -> None:
        p = self.row(t)
        for n in self.m.endogenous:
            i = self.c.at[n]
            if self.is_fixed(n, t):
                self.put_fixed(n, t)
                continue
            h, before = self.H[i][p], self.X[i][p - 1]
            if n in self.m.identities and self.m.identities[n].conditional:
                if not np.isfinite(h).all():
                    raise MdlError(f"conditional {n} needs data at {periods.year_period(t, self.freq)}")
                self.X[i][p] = h
                continue
            first = before if self.o.kind == "FORECAST" and self.R > 1 else h
            second = h if first is before else before
            self.X[i][p] = np.where(np.isfinite(first), first, second)
            if not np.isfinite(self.X[i][p]).all():
                raise MdlError(f"no start for {n} at {periods.year_period(t, self.freq)}")

    def state(self, names, p: int) -> np.ndarray:
        return np.array([self.X[self.c.at[n]][p] for n in names])

    def close(self, a: np.ndarray, b: np.ndarray) -> bool:
        return bool(np.all(100.0 * np.abs(b - a) < self.o.convergence * np.maximum(np.abs(a), 1.0)))

    def failed(self, what: str, n: int) -> int:
        if not self.o.retain:
            raise ConvergenceError(f"{what} did not converge in {n} iterations")
        warnings.warn(f"{what} did not converge; its last iteration stays", RuntimeWarning, stacklevel=2)
        return n

    def block(self, b: Block, active: tuple[str, ...], t: int) -> int:
        p, feedback = self.row(t), tuple(n for n in b.feedback if n in active)
        what = f"block {b.variables} at {periods.year_period(t, self.freq)}"
        dropped = set(self.o.jacobian_drop) & set(feedback)
        newton = self.o.algorithm != "GAUSS-SEIDEL"
        if newton and feedback and dropped == set(feedback):
            warnings.warn(f"{what}: no variable is left for Newton, Gauss-Seidel is used", RuntimeWarning, stacklevel=3)
            newton = False
        if not newton or not feedback:
            for k in range(1, self.o.max_iterations + 1):
                before = self.state(feedback, p)
                for n in active:
                    self.assign(n, p)
                if not feedback or self.close(before, self.state(feedback, p)):
                    return k
            return self.failed(what, self.o.max_iterations)
        if not dropped:
            return self.newton_block((b.variables, feedback), active, feedback, p, what)
        inner, rest = tuple(n for n in active if n not in dropped), tuple(n for n in feedback if n not in dropped)
        for k in range(1, self.o.max_iterations + 1):
            before = self.state(feedback, p)
            for n in active:
                if n in dropped:
                    self.assign(n, p)
            self.newton_block((b.variables, rest), inner, rest, p, what)
            if self.close(before, self.state(feedback, p)):
                return k
        return self.failed(what, self.o.max_iterations)

    def newton_block(self, key, active, unknowns, p: int, what: str) -> int:
        def residual(x: np.ndarray) -> np.ndarray:
            for n, v in zip(unknowns, x):
                self.X[self.c.at[n]][p] = v
            for n in active:
                self.assign(n, p)
            return self.state(unknowns, p) - x

        return self.newton(key, residual, self.state(unknowns, p), what)

    def newton(self, key, residual: Callable, x: np.ndarray, what: str, jacobian: Callable | None = None) -> int:
        rebuild, relax = RATES.get(self.o.algorithm, RATES["NEWTON"])
        shared = self.jacobians.get(key) if self.jacobians is not None else None
        J, step, before, ratio_before = shared, np.ones(x.shape[1]), None, 0.5
        for k in range(1, self.o.max_iterations + 1):
            r = residual(x)
            if J is None:
                J = jacobian(x, r) if jacobian else self.finite_differences(residual, x, r)
                self.store[key] = J
            try:
                change = (J.solve(-r) if isinstance(J, Banded) else np.linalg.solve(J, -r)) * step
            except np.linalg.LinAlgError:
                raise ConvergenceError(f"singular Jacobian of {what}") from None
            old, x = x, x + change
            if np.all(100.0 * np.abs(change) / np.maximum(np.abs(old), 1.0) < self.o.convergence):
                residual(x)
                return k
            size = np.max(np.abs(r), axis=0)
            if before is not None:
                with np.errstate(all="ignore"):
                    ratio = np.where(before > 0, size / before, 0.0)
                rate = np.sqrt(np.maximum(ratio * ratio_before, 0.0))
                if shared is None and self.R == 1 and rate.max() > rebuild:
                    J = None
                else:
                    step = np.where(rate > relax, np.maximum(step * 0.8, 0.5), step)
                ratio_before = ratio
            before = size
        residual(x)
        return self.failed(what, self.o.max_iterations)

    def finite_differences(self, residual: Callable, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Jacobian at the first replica."""
        h = self.o.jacobian_step * np.maximum(np.abs(x[:, 0]), 1.0)
        J = np.empty((len(x), len(x)))
        for j in range(len(x)):
            moved = x.copy()
            moved[j] += h[j]
            J[:, j] = (residual(moved)[:, 0] - r[:, 0]) / h[j]
        residual(x)
        return J

    # ---- leads: all periods at once

    def run_forward(self) -> Run:
        out = Run("DYNAMIC", self.start, self.end, self.freq, self.t0, self.c.names, self.X)
        unknowns: list[tuple[int, str]] = []
        for t in range(self.start, self.end + 1):
            for n in self.m.endogenous:
                if self.is_fixed(n, t):
                    self.put_fixed(n, t)
                elif not np.isfinite(self.X[self.c.at[n]][self.row(t)]).all():
                    raise MdlError(f"{n} is not defined at {periods.year_period(t, self.freq)}")
                else:
                    unknowns.append((self.row(t), n))
        used = 1
        if unknowns:
            names = {n for _, n in unknowns}
            dropped = set(self.o.jacobian_drop) & names
            if self.o.algorithm == "GAUSS-SEIDEL" or dropped == names:
                used = self.sweep(unknowns, unknowns)
            elif not dropped:
                used = self.stacked(unknowns)
            else:
                first, rest = [u for u in unknowns if u[1] in dropped], [u for u in unknowns if u[1] not in dropped]
                for used in range(1, self.o.max_iterations + 1):
                    before = self.stack(unknowns)
                    for p, n in first:
                        self.assign(n, p)
                    self.stacked(rest)
                    if self.close(before, self.stack(unknowns)):
                        break
                else:
                    used = self.failed("the forward-looking system", used)
            active = tuple(n for n in self.m.endogenous if n in names)
            out.blocks = [Block(active, True)]
        out.iterations = dict.fromkeys(range(self.start, self.end + 1), used)
        return out

    def stack(self, unknowns) -> np.ndarray:
        return np.array([self.X[self.c.at[n]][p] for p, n in unknowns])

    def sweep(self, unknowns, checked) -> int:
        for k in range(1, self.o.max_iterations + 1):
            before = self.stack(checked)
            for p, n in unknowns:
                self.assign(n, p)
            if self.close(before, self.stack(checked)):
                return k
        return self.failed("the forward-looking system", self.o.max_iterations)

    def stacked(self, unknowns) -> int:
        """Newton on all periods: residuals are computed by whole columns of periods, and the Jacobian from shocks to one variable at
        periods so far apart that they don't meet in an equation."""
        rows: dict[str, np.ndarray] = {}
        place: dict[str, np.ndarray] = {}
        for k, (p, n) in enumerate(unknowns):
            rows.setdefault(n, []).append(p)
            place.setdefault(n, []).append(k)
        rows = {n: np.array(v) for n, v in rows.items()}
        place = {n: np.array(v) for n, v in place.items()}

        def residual(x: np.ndarray) -> np.ndarray:
            for n, k in place.items():
                self.X[self.c.at[n]][rows[n]] = x[k]
            out = np.empty_like(x)
            for n, k in place.items():
                out[k] = self.value_at(n, rows[n]) - x[k]
            if not np.isfinite(out).all():
                raise MdlError("the forward-looking system is not finite")
            return out

        span = self.m.max_lag + self.m.max_lead + 1

        at = np.array([p for p, _ in unknowns])

        def jacobian(x: np.ndarray, r: np.ndarray) -> np.ndarray | Banded:
            h = self.o.jacobian_step * np.maximum(np.abs(x[:, 0]), 1.0)
            parts = []
            for n, k in place.items():
                for c in range(span):
                    own = k[rows[n] % span == c]
                    if not len(own):
                        continue
                    moved = x.copy()
                    moved[own] += h[own][:, None]
                    d = residual(moved)[:, 0] - r[:, 0]
                    hit = np.flatnonzero(d)
                    # an equation at period p sees shocks from p - max_lag to p + max_lead: one of them, as they are span apart
                    first = np.searchsorted(at[own], at[hit] - self.m.max_lag)
                    seen = own[np.minimum(first, len(own) - 1)]
                    parts.append((hit, seen, d[hit] / h[seen]))
            residual(x)
            e, o, v = (np.concatenate([q[i] for q in parts]) for i in range(3))
            return Banded(at, e, o, v) if len(x) > DENSE else dense(len(x), e, o, v)

        return self.newton(("stacked", tuple(unknowns)), residual, self.stack(unknowns), "the forward-looking system", jacobian)

    def value_at(self, n: str, rows: np.ndarray) -> np.ndarray:
        v = self.value(n, rows)
        return np.broadcast_to(v, (len(rows), self.R))

    # ---- residual check

    def residual_check(self) -> Run:
        H, p = self.H, np.arange(self.row(self.start), self.row(self.end) + 1)
        out = Run("RESCHECK", self.start, self.end, self.freq, self.t0, self.c.names, [h.copy() for h in H], {t: 1 for t in range(self.start, self.end + 1)}, blocks(self.m))
        for n in self.m.endogenous:
            i = self.c.at[n]
            with np.errstate(all="ignore"):
                fitted = np.broadcast_to(self.c.solve[n](H, H, H, self.A, p), (len(p), self.R))
                gap = np.broadcast_to(self.c.lhs[n](H, H, H, self.A, p) - self.c.rhs[n](H, H, H, self.A, p), (len(p), self.R))
            if not (np.isfinite(fitted).all() and np.isfinite(H[i][p]).all()):
                raise MdlError(f"residual check of {n}: values are missing or not finite")
            out.X[i][p] = fitted
            out.add_factors[n] = gap
        return out
