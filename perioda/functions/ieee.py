"""Arithmetic with IEEE results under NULL-as-missing: no NaN is stored, infinities are kept, ANSI mode or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clean(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def div(a: Column, b: Column) -> Column:
    """a / b; by zero: infinity of a's sign, and missing for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    safe = F.when(b != 0, b)
    return clean(F.when(b != 0, a / safe).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF)))


def ln(x: Column) -> Column:
    """Natural logarithm; -infinity at 0, missing below."""
    x = x.cast("double")
    return F.when(x > 0, F.ln(F.when(x > 0, x))).when(x == 0, F.lit(-INF))


def power(a: Column, b: Column) -> Column:
    """a ** b; 1 for an exponent of 0 or a base of 1, whatever the other is, as IEEE has it."""
    a, b = a.cast("double"), b.cast("double")
    one = (b == 0) | (a == 1) | ((a == -1) & (F.abs(b) == INF))
    return F.when(one, F.lit(1.0)).otherwise(clean(F.pow(a, b)))


def floordiv(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    q = F.when(b != 0, a / F.when(b != 0, b))
    down = F.when(F.abs(q) < 4.5e15, F.floor(F.when(F.abs(q) < 4.5e15, q)).cast("double")).otherwise(q)
    return clean(F.when(b != 0, down).otherwise(div(a, b)))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; missing for a divisor of 0."""
    a, b = a.cast("double"), b.cast("double")
    return clean(F.when(b != 0, a - b * floordiv(a, b)))


def add(a: Column, b: Column) -> Column:
    return clean(a.cast("double") + b.cast("double"))


def sub(a: Column, b: Column) -> Column:
    return clean(a.cast("double") - b.cast("double"))


def mul(a: Column, b: Column) -> Column:
    return clean(a.cast("double") * b.cast("double"))


def exp(x: Column) -> Column:
    return F.exp(x.cast("double"))
