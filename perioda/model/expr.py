"""Expressions of the equation language: tokens, parser, tree, and lowering to variables at fixed offsets."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass


class MdlError(ValueError):
    """Something in a model or its use is wrong."""


class MdlSyntaxError(MdlError):
    def __init__(self, message: str, line: int | None = None) -> None:
        super().__init__(message if line is None else f"line {line}: {message}")
        self.line = line


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Variable:
    name: str
    offset: int = 0


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Expression


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Call:
    name: str
    arg: Expression
    period: int = 1


Expression = Number | Variable | Unary | Binary | Call
# Fixed values of the language: functions and their other names; operators' spelled forms; binding powers.
FUNCTIONS = {"ABS": "ABS", "EXP": "EXP", "LOG": "LOG", "TSLAG": "TSLAG", "LAG": "TSLAG", "TSLEAD": "TSLEAD", "LEAD": "TSLEAD", "TSDELTA": "TSDELTA", "DEL": "TSDELTA", "TSDELTALOG": "TSDELTALOG", "TSDELTAP": "TSDELTAP", "MOVAVG": "MOVAVG", "MAVE": "MOVAVG", "MOVSUM": "MOVSUM", "MTOT": "MOVSUM"}
TEMPORAL = {"TSLAG", "TSLEAD", "TSDELTA", "TSDELTALOG", "TSDELTAP", "MOVAVG", "MOVSUM"}
SPELLED = {".EQ.": "==", ".NE.": "!=", ".GE.": ">=", ".LE.": "<=", ".GT.": ">", ".LT.": "<"}
POWERS = {"|": 10, "&": 20, "==": 30, "!=": 30, ">=": 30, "<=": 30, ">": 30, "<": 30, "+": 40, "-": 40, "*": 50, "/": 50, "^": 70}
UNARY_POWER = 60
COMPARISONS, LOGIC = {"==", "!=", ">=", "<=", ">", "<"}, {"&", "|"}
TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\.(?:EQ|NE|GE|LE|GT|LT)\.|==|!=|>=|<=|[-+*/^()<>&|,=]))", re.IGNORECASE)


def tokens(text: str, line: int | None = None) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None or (m.lastgroup == "num" and m[0].strip().endswith(".") and re.match(r"(?:EQ|NE|GE|LE|GT|LT)\.", text[m.end() :], re.IGNORECASE)):
            if m is None:
                raise MdlSyntaxError(f"unexpected {text[at:].strip()[:10]!r}", line)
            out.append(("num", m["num"][:-1]))  # 1.EQ.2: the point belongs to the operator
            at = m.end() - 1
            continue
        out.append((m.lastgroup, SPELLED.get(m[0].strip().upper(), m[0].strip())))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, line: int | None) -> None:
        self.all, self.at, self.line = tokens(text, line), 0, line

    def peek(self) -> tuple[str, str]:
        return self.all[self.at] if self.at < len(self.all) else ("end", "")

    def take(self, what: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if what is not None and text != what:
            raise MdlSyntaxError(f"expected {what!r}, found {text or 'the end'!r}", self.line)
        self.at += 1
        return kind, text

    def expression(self, least: int = 0) -> Expression:
        left = self.prefix()
        while (op := self.peek()[1]) in POWERS and POWERS[op] >= least and self.peek()[0] == "op":
            self.take()
            left = Binary(op, left, self.expression(POWERS[op] if op == "^" else POWERS[op] + 1))
        return left

    def prefix(self) -> Expression:
        kind, text = self.take()
        if kind == "num":
            return Number(float(text))
        if text in ("+", "-") and kind == "op":
            return Unary(text, self.expression(UNARY_POWER))
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "name":
            if self.peek()[1] == "(":
                return self.call(text)
            if text.lower() == "pi":
                return Number(math.pi)
            if text.upper() in FUNCTIONS:
                raise MdlSyntaxError(f"{text} needs arguments", self.line)
            return Variable(text)
        raise MdlSyntaxError(f"unexpected {text or 'end'!r}", self.line)

    def call(self, name: str) -> Expression:
        known = FUNCTIONS.get(name.upper())
        if known is None:
            raise MdlSyntaxError(f"unknown function {name}", self.line)
        self.take("(")
        arg, period = self.expression(), None
        if self.peek()[1] == ",":
            self.take()
            value = numeric(self.expression())
            if known not in TEMPORAL or value is None or value != int(value) or value < (0 if known in ("TSLAG", "TSLEAD") else 1):
                raise MdlSyntaxError(f"bad second argument of {name}", self.line)
            period = int(value)
        self.take(")")
        return Call(known, arg, 1 if period is None else period)


def parse_expression(text: str, line: int | None = None) -> Expression:
    p = _Parser(text, line)
    if not p.all:
        raise MdlSyntaxError("an expression is needed", line)
    out = p.expression()
    if p.peek()[0] != "end":
        raise MdlSyntaxError(f"unexpected {p.peek()[1]!r}", line)
    return out


def numeric(e: Expression) -> float | None:
    """Value of an expression of numbers alone, else None."""
    if isinstance(e, Number):
        return e.value
    if isinstance(e, Unary):
        v = numeric(e.arg)
        return None if v is None else -v if e.op == "-" else v
    if isinstance(e, Binary) and e.op in "+-*/^":
        a, b = numeric(e.left), numeric(e.right)
        if a is not None and b is not None:
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b}[e.op]()
    return None


def walk(e: Expression) -> Iterator[Expression]:
    yield e
    for child in (e.left, e.right) if isinstance(e, Binary) else (e.arg,) if isinstance(e, (Unary, Call)) else ():
        yield from walk(child)


def variable_names(e: Expression) -> set[str]:
    return {x.name for x in walk(e) if isinstance(x, Variable)}


def shifted(e: Expression, k: int) -> Expression:
    """A lowered expression k periods later."""
    if isinstance(e, Variable):
        return Variable(e.name, e.offset + k)
    if isinstance(e, Binary):
        return Binary(e.op, shifted(e.left, k), shifted(e.right, k))
    if isinstance(e, Unary):
        return Unary(e.op, shifted(e.arg, k))
    return Call(e.name, shifted(e.arg, k)) if isinstance(e, Call) else e


def lowered(e: Expression) -> Expression:
    """The expression with temporal functions written out: variables at offsets, arithmetic, ABS, EXP and LOG remain."""
    if isinstance(e, Binary):
        return Binary(e.op, lowered(e.left), lowered(e.right))
    if isinstance(e, Unary):
        return Unary(e.op, lowered(e.arg))
    if not isinstance(e, Call):
        return e
    x, n = lowered(e.arg), e.period
    if e.name == "TSLAG":
        return shifted(x, -n)
    if e.name == "TSLEAD":
        return shifted(x, n)
    if e.name == "TSDELTA":
        return Binary("-", x, shifted(x, -n))
    if e.name == "TSDELTALOG":
        return Binary("-", Call("LOG", x), Call("LOG", shifted(x, -n)))
    if e.name == "TSDELTAP":
        return Binary("*", Number(100.0), Binary("-", Binary("/", x, shifted(x, -n)), Number(1.0)))
    if e.name in ("MOVAVG", "MOVSUM"):
        total = shifted(x, 1 - n)
        for k in range(n - 2, -1, -1):
            total = Binary("+", total, shifted(x, -k))
        return total if e.name == "MOVSUM" or n == 1 else Binary("/", total, Number(float(n)))
    return Call(e.name, x)


def offsets(e: Expression) -> dict[str, set[int]]:
    """Offsets at which each variable is used."""
    out: dict[str, set[int]] = {}
    for x in walk(lowered(e)):
        if isinstance(x, Variable):
            out.setdefault(x.name, set()).add(x.offset)
    return out


def temporal_offsets(e: Expression) -> tuple[int, int]:
    """Largest lag and lead."""
    every = [o for s in offsets(e).values() for o in s]
    return max([0, *(-o for o in every)]), max([0, *every])


def is_logical(e: Expression) -> bool:
    return isinstance(e, Binary) and (e.op in COMPARISONS or e.op in LOGIC)


def source(e: Expression, leaf: Callable[[str, int], str]) -> str:
    """Python source of a lowered expression over the helpers of a kernel; variables by leaf(name, offset)."""
    if isinstance(e, Number):
        return repr(e.value)
    if isinstance(e, Variable):
        return leaf(e.name, e.offset)
    if isinstance(e, Unary):
        return f"({'-' if e.op == '-' else ''}{source(e.arg, leaf)})"
    if isinstance(e, Call):
        return f"{e.name.lower()}_({source(e.arg, leaf)})"
    a, b = source(e.left, leaf), source(e.right, leaf)
    if e.op == "/":
        return f"div_({a}, {b})"
    if e.op == "^":
        return f"pow_({a}, {b})"
    return f"({a} {e.op} {b})"
