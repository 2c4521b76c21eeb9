"""Model documents: statements, behavioural equations and identities, and what follows from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from .expr import FUNCTIONS, Binary, Call, Expression, MdlError, MdlSyntaxError, Number, Unary, Variable, is_logical, offsets, parse_expression, temporal_offsets, variable_names

DIRECTIVES = ("BEHAVIORAL", "EQUATION", "IDENTITY", "EQ", "COEFF", "ERROR", "RESTRICT", "PDL", "IF", "IV", "STORE", "TSRANGE")
START = re.compile(r"^\s*([A-Za-z]+)\s*>(.*)$", re.DOTALL)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LHS = ("LOG", "EXP", "TSDELTA", "TSDELTALOG", "TSDELTAP")
YP = tuple[int, int]


@dataclass(frozen=True)
class TimeRange:
    start: YP
    end: YP


@dataclass(frozen=True)
class Pdl:
    coefficient: str
    degree: int
    length: int
    near: bool = False
    far: bool = False


@dataclass(frozen=True)
class Restriction:
    """Sum of (multiplier, coefficient, PDL lag or None) equal to value."""

    terms: tuple[tuple[float, str, int | None], ...]
    value: float


@dataclass(frozen=True)
class Equation:
    """function(dependent, n periods) = rhs; function IDENTITY leaves the dependent as it is."""

    dependent: str
    function: str
    periods: int
    rhs: Expression
    text: str
    line: int


@dataclass(frozen=True)
class Behavioral:
    equation: Equation
    coefficients: tuple[str, ...]
    regressors: tuple[Expression, ...]
    time_range: TimeRange | None = None
    error_order: int = 0
    restrictions: tuple[Restriction, ...] = ()
    pdls: tuple[Pdl, ...] = ()
    instruments: tuple[Expression, ...] = ()

    @property
    def name(self) -> str:
        return self.equation.dependent

    def terms(self) -> list[tuple[str, Expression, int]]:
        """(coefficient, regressor, lag) with polynomial lags written out as c__PDL__k."""
        lengths = {p.coefficient: p.length for p in self.pdls}
        return [(f"{c}__PDL__{k}" if c in lengths else c, r, k) for c, r in zip(self.coefficients, self.regressors) for k in range(lengths.get(c, 1))]


@dataclass(frozen=True)
class Identity:
    """Alternatives (condition or None, equation) in order; the first that holds counts."""

    name: str
    alternatives: tuple[tuple[Expression | None, Equation], ...]

    @property
    def conditional(self) -> bool:
        return any(c is not None for c, _ in self.alternatives)


@dataclass
class Model:
    text: str
    name: str = "model"
    behaviorals: dict[str, Behavioral] = field(default_factory=dict)
    identities: dict[str, Identity] = field(default_factory=dict)

    @cached_property
    def endogenous(self) -> tuple[str, ...]:
        return (*self.behaviorals, *self.identities)

    def expressions(self, name: str, instruments: bool = False) -> list[tuple[Expression, int]]:
        """(expression, extra lag) of all that an equation uses."""
        if name in self.behaviorals:
            b = self.behaviorals[name]
            return [(r, k) for _, r, k in b.terms()] + ([(i, 0) for i in b.instruments] if instruments else [])
        return [(x, 0) for c, e in self.identities[name].alternatives for x in ((c, e.rhs) if c is not None else (e.rhs,))]

    @cached_property
    def exogenous(self) -> tuple[str, ...]:
        used = {v for n in self.endogenous for e, _ in self.expressions(n, True) for v in variable_names(e)}
        return tuple(sorted(used - set(self.endogenous)))

    def _equations(self, name: str) -> list[Equation]:
        return [self.behaviorals[name].equation] if name in self.behaviorals else [e for _, e in self.identities[name].alternatives]

    @cached_property
    def max_lag(self) -> int:
        most = 0
        for n in self.endogenous:
            own = max([0, *(temporal_offsets(e)[0] + k for e, k in self.expressions(n, True))])
            own = max([own, *(e.periods for e in self._equations(n) if e.function.startswith("TSDELTA"))])
            most = max(most, own + (self.behaviorals[n].error_order if n in self.behaviorals else 0))
        return most

    @cached_property
    def max_lead(self) -> int:
        return max([0, *(temporal_offsets(e)[1] - k for n in self.endogenous for e, k in self.expressions(n))])

    @cached_property
    def dependencies(self) -> dict[str, tuple[str, ...]]:
        """Endogenous variables that each one needs in the same period."""
        own = set(self.endogenous)
        return {n: tuple(v for v in self.endogenous if v in own and any(k == 0 and 0 in offsets(e).get(v, ()) for e, k in self.expressions(n))) for n in self.endogenous}

    def behavioral(self, name: str) -> Behavioral:
        return self.behaviorals[name]

    def identity(self, name: str) -> Identity:
        return self.identities[name]

    def bind(self, data):
        """The model with its data, as which it can be estimated, simulated and so on; the methods below bind and go on."""
        from .simulate import bind_model_data

        return bind_model_data(self, data)

    def estimate(self, data, **how):
        from .estimate import estimate

        return estimate(self, data, **how)

    def simulate(self, data, time_range, **how):
        return self.bind(data).simulate(time_range, **how)

    def stochastic_simulate(self, data, time_range, disturbances, **how):
        return self.bind(data).stochastic_simulate(time_range, disturbances, **how)

    def multiplier_matrix(self, data, time_range, targets, instruments, **how):
        return self.bind(data).multiplier_matrix(time_range, targets, instruments, **how)

    def renormalize(self, data, time_range, targets, instruments, **how):
        return self.bind(data).renormalize(time_range, targets, instruments, **how)

    def optimize(self, data, time_range, bounds, objective_functions, restrictions=(), **how):
        return self.bind(data).optimize(time_range, bounds, objective_functions, restrictions, **how)

    @classmethod
    def from_text(cls, text: str, name: str = "model") -> Model:
        return parse_mdl(text, name)

    @classmethod
    def from_file(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            return parse_mdl(f.read(), path.rsplit("/", 1)[-1])


def load_model(model_file: str | None = None, model_text: str | None = None, name: str = "model") -> Model:
    """Model from its text, or else from a file."""
    if model_text is not None:
        return Model.from_text(model_text, name)
    if model_file is None:
        raise MdlError("a model needs a text or a file")
    return Model.from_file(model_file)


def statements(text: str) -> list[tuple[str, str, int]]:
    """(directive, argument, line) of the document between MODEL and END."""
    lines = [(i, x.strip()) for i, x in enumerate(text.splitlines(), 1)]
    lines = [(i, x) for i, x in lines if x and not x.startswith("$") and not x.upper().startswith("COMMENT>")]
    if not lines or lines[0][1] != "MODEL":
        raise MdlSyntaxError("the first line must be MODEL", lines[0][0] if lines else None)
    if lines[-1][1] != "END":
        raise MdlSyntaxError("the last line must be END", lines[-1][0])
    out: list[list] = []
    for i, x in lines[1:-1]:
        if "$" in x:
            raise MdlSyntaxError("'$' starts a comment only at the start of a line", i)
        m = START.match(x)
        if m and m[1].upper() in DIRECTIVES:
            out.append([m[1].upper(), m[2].strip(), i])
        elif m and not any(op in m[1] for op in "()+-*/"):
            raise MdlSyntaxError(f"unknown directive {m[1]}", i)
        elif not out:
            raise MdlSyntaxError("a directive is needed", i)
        else:
            out[-1][1] += (" ; " if out[-1][0] == "RESTRICT" and out[-1][1] else " ") + x
    return [tuple(x) for x in out]


def _name(text: str, line: int, what: str) -> str:
    if not NAME.fullmatch(text) or "__" in text or text.upper() in FUNCTIONS or text.lower() == "pi":
        raise MdlSyntaxError(f"bad {what} name {text!r}", line)
    return text


def _range(text: str, line: int) -> TimeRange:
    parts = text.split()
    if len(parts) != 4 or not all(p.isdigit() and int(p) > 0 for p in parts):
        raise MdlSyntaxError("TSRANGE needs four positive whole numbers", line)
    y1, p1, y2, p2 = map(int, parts)
    return TimeRange((y1, p1), (y2, p2))


def _equation(text: str, name: str, line: int) -> Equation:
    left, eq, right = text.partition("=")
    if not eq or not right.strip() or left.rstrip()[-1:] in "<>!" or right[:1] == "=":
        raise MdlSyntaxError("an equation needs one '='", line)
    lhs = parse_expression(left, line)
    function, periods = "IDENTITY", 1
    if isinstance(lhs, Call):
        if lhs.name not in LHS or not isinstance(lhs.arg, Variable):
            raise MdlSyntaxError("the left side must be a variable or one function of it", line)
        function, periods, lhs = lhs.name, lhs.period, lhs.arg
    if not isinstance(lhs, Variable) or lhs.name != name:
        raise MdlSyntaxError(f"the left side must be {name}", line)
    return Equation(name, function, periods, parse_expression(right, line), text, line)


def _terms(e: Expression, sign: int = 1) -> list[tuple[int, Expression]]:
    if isinstance(e, Binary) and e.op in "+-":
        return _terms(e.left, sign) + _terms(e.right, sign if e.op == "+" else -sign)
    if isinstance(e, Unary):
        return _terms(e.arg, sign if e.op == "+" else -sign)
    return [(sign, e)]


def _factor(e: Expression, names: tuple[str, ...]) -> tuple[str, Expression] | None:
    """(coefficient, rest) of a product whose leftmost factor is a coefficient."""
    if isinstance(e, Variable) and e.name in names:
        return e.name, Number(1.0)
    if isinstance(e, Binary) and e.op in "*/":
        found = _factor(e.left, names)
        if found:
            c, rest = found
            return c, e.right if rest == Number(1.0) and e.op == "*" else Binary(e.op, rest, e.right)
    return None


def _regressors(rhs: Expression, names: tuple[str, ...], line: int) -> tuple[Expression, ...]:
    out: list[Expression] = []
    terms = _terms(rhs)
    if len(terms) != len(names):
        raise MdlSyntaxError("each coefficient needs one term of the equation", line)
    for (sign, e), c in zip(terms, names):
        found = _factor(e, names)
        if found is None or found[0] != c or variable_names(found[1]) & set(names):
            raise MdlSyntaxError(f"the equation must be linear in the coefficients, in their order (at {c})", line)
        out.append(found[1] if sign > 0 else Unary("-", found[1]))
    if sum(not variable_names(r) for r in out) > 1:
        raise MdlSyntaxError("an equation has one intercept at most", line)
    return tuple(out)


def _pdl(text: str, names: tuple[str, ...], line: int) -> Pdl:
    parts = text.split()
    if len(parts) < 3 or parts[0] not in names or not all(p.isdigit() for p in parts[1:3]) or any(p.upper() not in ("N", "F") for p in parts[3:]):
        raise MdlSyntaxError("PDL needs a coefficient, a degree, a length and perhaps N or F", line)
    degree, length, flags = int(parts[1]), int(parts[2]), {p.upper() for p in parts[3:]}
    if length <= degree or length < 1:
        raise MdlSyntaxError("the length of a PDL must exceed its degree", line)
    return Pdl(parts[0], degree, length, "N" in flags, "F" in flags)


def _restriction(text: str, names: tuple[str, ...], pdls: tuple[Pdl, ...], line: int) -> Restriction:
    left, eq, right = text.partition("=")
    lengths = {p.coefficient: p.length for p in pdls}
    try:
        value = float(right)
    except ValueError:
        raise MdlSyntaxError("a restriction needs '=' and a number", line) from None
    out: list[tuple[float, str, int | None]] = []
    for sign, e in _terms(parse_expression(left, line)):
        m = float(sign)
        if isinstance(e, Binary) and e.op == "*" and isinstance(e.left, Number):
            m, e = m * e.left.value, e.right
        if isinstance(e, Call) and e.name == "TSLAG" and isinstance(e.arg, Variable) and e.period < lengths.get(e.arg.name, 0):
            out.append((m, e.arg.name, e.period))
        elif isinstance(e, Variable) and e.name in names:
            out.append((m, e.name, 0 if e.name in lengths else None))
        else:
            raise MdlSyntaxError("a restriction is a sum of multiples of coefficients", line)
    if not eq or len({t[1:] for t in out}) != len(out):
        raise MdlSyntaxError("the terms of a restriction must differ", line)
    return Restriction(tuple(out), value)


def parse_mdl(text: str, name: str = "model") -> Model:
    """Model of a document; MdlSyntaxError with the line where it is wrong."""
    model, groups = Model(text, name), []
    for kind, arg, line in statements(text):
        if kind in ("BEHAVIORAL", "EQUATION", "IDENTITY"):
            groups.append((kind, arg, line, []))
        elif not groups:
            raise MdlSyntaxError(f"{kind} outside of an equation", line)
        else:
            groups[-1][3].append((kind, arg, line))
    found: dict[str, list] = {}
    for kind, head, line, body in groups:
        parts = head.split(None, 1)
        if not parts:
            raise MdlSyntaxError("a name is needed", line)
        own, time_range = _name(parts[0], line, "variable"), None
        if len(parts) > 1:
            if not parts[1].upper().startswith("TSRANGE"):
                raise MdlSyntaxError(f"unexpected {parts[1]!r}", line)
            time_range = _range(parts[1][7:].lstrip(" >"), line)
        if kind == "IDENTITY":
            found.setdefault(own, []).extend(_identity(own, body, line))
            if own in model.behaviorals:
                raise MdlSyntaxError(f"{own} has two equations", line)
            continue
        if own in model.behaviorals or own in found:
            raise MdlSyntaxError(f"{own} has two equations", line)
        model.behaviorals[own] = _behavioral(own, body, line, time_range)
    for own, alternatives in found.items():
        if len({(e.function, e.periods) for _, e in alternatives}) > 1:
            raise MdlSyntaxError(f"the alternatives of {own} must share the left side's function", alternatives[0][1].line)
        if len(alternatives) > 1 and any(c is None for c, _ in alternatives):
            raise MdlSyntaxError(f"{own} has two equations without a condition", alternatives[0][1].line)
        model.identities[own] = Identity(own, tuple(alternatives))
    if not model.endogenous:
        raise MdlSyntaxError("a model needs equations")
    clash = {c for b in model.behaviorals.values() for c in b.coefficients} & set(model.endogenous)
    if clash:
        raise MdlSyntaxError(f"coefficients named like variables: {sorted(clash)}")
    return model


def _identity(own: str, body: list, line: int) -> list:
    out, equation, condition = [], None, None
    for kind, arg, at in body:
        if kind == "EQ":
            if equation is not None:
                out.append((condition, equation))
                condition = None
            equation = _equation(arg, own, at)
        elif kind == "IF":
            condition = parse_expression(arg, at)
            if not is_logical(condition) or not variable_names(condition):
                raise MdlSyntaxError("a condition needs a comparison and a variable", at)
        elif kind != "STORE":
            raise MdlSyntaxError(f"{kind} in an identity", at)
    if equation is None:
        raise MdlSyntaxError(f"{own} has no equation", line)
    return [*out, (condition, equation)]


def _behavioral(own: str, body: list, line: int, time_range: TimeRange | None) -> Behavioral:
    by: dict[str, list] = {}
    for kind, arg, at in body:
        if kind == "IF":
            raise MdlSyntaxError("IF in a behavioural equation", at)
        by.setdefault(kind, []).append((arg, at))
    for kind in ("EQ", "COEFF"):
        if len(by.get(kind, [])) != 1:
            raise MdlSyntaxError(f"{own} needs one {kind}", line)
    for kind in ("ERROR", "TSRANGE"):
        if len(by.get(kind, [])) > 1:
            raise MdlSyntaxError(f"{own} has several {kind}", line)
    text, at = by["COEFF"][0]
    names = tuple(_name(c, at, "coefficient") for c in text.replace(",", " ").split())
    if not names or len(set(names)) != len(names):
        raise MdlSyntaxError("coefficients must differ", at)
    text, at = by["EQ"][0]
    equation = _equation(text, own, at)
    regressors = _regressors(equation.rhs, names, at)
    order = 0
    if "ERROR" in by:
        text, at = by["ERROR"][0]
        m = re.fullmatch(r"AUTO\(\s*([1-9])\s*\)", text)
        if not m:
            raise MdlSyntaxError("ERROR needs AUTO(n), n from 1 to 9", at)
        order = int(m[1])
    pdls = tuple(_pdl(x, names, at) for text, at in by.get("PDL", []) for x in text.split(";") if x.strip())
    for p in pdls:
        if not variable_names(regressors[names.index(p.coefficient)]):
            raise MdlSyntaxError("an intercept has no polynomial lags", line)
    if len({p.coefficient for p in pdls}) != len(pdls):
        raise MdlSyntaxError("a coefficient has one PDL at most", line)
    restrictions = tuple(_restriction(x, names, pdls, at) for text, at in by.get("RESTRICT", []) for x in text.split(";") if x.strip())
    if "TSRANGE" in by:
        time_range = _range(*by["TSRANGE"][0])
    instruments = tuple(parse_expression(text, at) for text, at in by.get("IV", []))
    return Behavioral(equation, names, regressors, time_range, order, restrictions, pdls, instruments)
