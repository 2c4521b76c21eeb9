"""Frequencies, period ordinals and calendar dates, for the driver and as Column expressions.

A period (year, period) of a series with f periods a year is the ordinal t = year * f + period - 1. Daily series have 366 slots in every
year and weekly ones 53, so ordinals are not day counts.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = (1, 2, 3, 4, 12, 24, 36, 53, 366)
LETTERS = {"A": 1, "Y": 1, "S": 2, "Q": 4, "M": 12, "W": 53, "D": 366}


def frequency(value: int | str) -> int:
    """Periods a year from a number, its text or a letter (A or Y, S, Q, M, W, D)."""
    if isinstance(value, bool):
        raise TypeError("a frequency is a number or a letter")
    if isinstance(value, str):
        text = value.strip().upper()
        value = LETTERS[text] if text in LETTERS else int(text) if text.isdigit() else 0
    if value not in FREQUENCIES:
        raise ValueError(f"unknown frequency: {value}")
    return int(value)


def ordinal(year: int, period: int, freq: int) -> int:
    return year * freq + period - 1


def year_period(t: int, freq: int) -> tuple[int, int]:
    return t // freq, t % freq + 1


def normalize_year_period(yp: tuple[int, int], freq: int) -> tuple[int, int]:
    """The (year, period) meant by one whose period may lie outside its year; any positive freq."""
    if freq < 1:
        raise ValueError("freq must be positive")
    return year_period(ordinal(*yp, freq), freq)


def num_periods(start: tuple[int, int], end: tuple[int, int], freq: int) -> int:
    """Signed number of periods from start to end."""
    return ordinal(*end, freq) - ordinal(*start, freq)


def shift(yp: tuple[int, int], n: int, freq: int) -> tuple[int, int]:
    return year_period(ordinal(*yp, freq) + n, freq)


def is_leap(year: int) -> bool:
    return calendar.isleap(year)


def date_to_year_period(d: dt.date, freq: int | str) -> tuple[int, int]:
    f, doy = frequency(freq), d.timetuple().tm_yday
    if f == 366:
        p = doy
    elif f == 53:
        p = min(53, (doy - 1) // 7 + 1)
    elif f == 24:
        p = (d.month - 1) * 2 + 1 + (d.day > 15)
    elif f == 36:
        p = (d.month - 1) * 3 + 1 + (d.day > 10) + (d.day > 20)
    else:
        p = min(f, (d.month * f - 1) // 12 + 1)
    return d.year, p


def year_period_to_date(yp: tuple[int, int], freq: int | str, last: bool = True) -> dt.date | None:
    """Last or first day of a period; None for slot 366 of a year of 365 days."""
    f = frequency(freq)
    y, p = normalize_year_period(yp, f)
    length = 366 if is_leap(y) else 365
    if f in (366, 53):
        doy = p if f == 366 else min(p * 7 if p < 53 else length, length) if last else (p - 1) * 7 + 1
        return None if doy > length else dt.date(y, 1, 1) + dt.timedelta(doy - 1)
    if f in (24, 36):
        m, k = divmod(p - 1, f // 12)
        cuts = (1, 16) if f == 24 else (1, 11, 21)
        end = calendar.monthrange(y, m + 1)[1]
        return dt.date(y, m + 1, (cuts[k + 1] - 1 if k + 1 < len(cuts) else end) if last else cuts[k])
    m = p * 12 // f if last else (p - 1) * 12 // f + 1
    return dt.date(y, m, calendar.monthrange(y, m)[1] if last else 1)


def java_pattern(strftime: str) -> str:
    """Spark's date pattern for a strftime format; %q is the quarter."""
    codes = {"Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "q": "q", "%": "%"}
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%" and i + 1 < len(strftime):
            out += codes[strftime[i + 1]]
            i += 2
        else:
            out += f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]
            i += 1
    return out


# ---- Columns


def year_of(t: Column, freq: int) -> Column:
    return F.floor(t / F.lit(freq)).cast("int")


def period_of(t: Column, freq: int) -> Column:
    return (F.pmod(t, F.lit(freq)) + 1).cast("int")


def date_to_t(d: Column, freq: int | str) -> Column:
    """Ordinal of the period that holds a date."""
    f = frequency(freq)
    y, m, day, doy = F.year(d), F.month(d), F.dayofmonth(d), F.dayofyear(d)
    if f == 366:
        p = doy
    elif f == 53:
        p = F.least(F.lit(53), F.floor((doy - 1) / 7) + 1)
    elif f == 24:
        p = (m - 1) * 2 + 1 + (day > 15).cast("int")
    elif f == 36:
        p = (m - 1) * 3 + 1 + (day > 10).cast("int") + (day > 20).cast("int")
    else:
        p = F.least(F.lit(f), F.floor((m * f - 1) / 12) + 1)
    return y.cast("long") * f + p.cast("long") - 1


def _jan1(y: Column) -> Column:
    return F.make_date(y, F.lit(1), F.lit(1))


def leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def t_to_date(t: Column, freq: int | str, last: bool = True) -> Column:
    """Last or first day of a period; null for slot 366 of a year of 365 days."""
    f = frequency(freq)
    y, p = year_of(t, f), period_of(t, f)
    length = F.when(leap(y), F.lit(366)).otherwise(F.lit(365))
    if f in (366, 53):
        doy = p if f == 366 else F.when(p < 53, F.least(p * 7, length)).otherwise(length) if last else (p - 1) * 7 + 1
        return F.when(doy <= length, F.date_add(_jan1(y), (doy - 1).cast("int")))
    if f in (24, 36):
        k, each = (p - 1) % (f // 12), 15 if f == 24 else 10
        month = F.floor((p - 1) / F.lit(f // 12)).cast("int") + 1
        start = F.make_date(y, month, F.lit(1))
        if not last:
            return F.date_add(start, (k * each).cast("int"))
        return F.when(k == f // 12 - 1, F.last_day(start)).otherwise(F.date_add(start, (k * each + each - 1).cast("int")))
    each = 12 // f
    if last:
        return F.last_day(F.make_date(y, (p * each).cast("int"), F.lit(1)))
    return F.make_date(y, ((p - 1) * each + 1).cast("int"), F.lit(1))
