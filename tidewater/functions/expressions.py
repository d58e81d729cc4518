"""Column builders with the rules of the scalar expressions: which operations pass null on, and which count it as false."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.operators.missing import truth

UNITS = ("year", "month", "day", "hour", "minute", "second")


def as_text(c: Column) -> Column:
    """A value as text; whole doubles without a decimal point."""
    plain = c.cast("string")
    return F.when(plain.rlike(r"^-?[0-9]+\.0$"), F.regexp_replace(plain, r"\.0$", "")).otherwise(plain)


def plus(a: Column, b: Column, text: bool = False) -> Column:
    """Sum, or both texts one after the other if `text`; null with null."""
    return F.concat(as_text(a), as_text(b)) if text else a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column) -> Column:
    return a * b


def over(a: Column, b: Column, null_on_error: bool = False) -> Column:
    """Quotient; a divisor 0 is an error, or null."""
    return F.try_divide(a, b) if null_on_error else F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(a / b)


def modulo(a: Column, b: Column, null_on_error: bool = False) -> Column:
    return F.try_mod(a, b) if null_on_error else F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(a % b)


def both(*conditions: Column) -> Column:
    """And, null counting as false."""
    out = F.lit(True)
    for c in conditions:
        out = out & truth(c)
    return out


def either(*conditions: Column) -> Column:
    """Or, null counting as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | truth(c)
    return out


def negated(condition: Column) -> Column:
    """Not; of null it is true."""
    return ~truth(condition)


def like(c: Column, pattern: str) -> Column:
    """% and _ as in SQL, across lines too; false for null."""
    return truth(c.like(pattern))


def first_known(*columns: Column) -> Column:
    return F.coalesce(*columns)


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", "")


def substring(c: Column, start: Column, size: Column | None = None) -> Column:
    """From the character `start` (1 is the first, lower ones count as 1), to the end or `size` characters."""
    return F.substring(c, F.greatest(start, F.lit(1)).cast("int"), F.length(c) if size is None else size.cast("int"))


def concat(*columns: Column) -> Column:
    return F.concat(*[as_text(c) for c in columns])


def absolute(c: Column) -> Column:
    return F.abs(c)


def floor(c: Column) -> Column:
    return F.floor(c)


def ceil(c: Column) -> Column:
    return F.ceil(c)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounded, ties towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


def date_trunc(unit: str, c: Column) -> Column:
    """The beginning of the year, month, day, hour, minute or second; null stays null."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    return F.date_trunc(unit, c)


def iff(condition: Column, a: Any, b: Any) -> Column:
    return F.when(truth(condition), a).otherwise(b)


def divide(a: Column, b: Column) -> Column:
    """Quotient of a series, by the rule that dividing by 0 gives plus infinity."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("inf")))).otherwise(F.try_divide(a.cast("double"), b))


def unix_time(c: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(c.cast("timestamp"))


MILLISECONDS = {"milliseconds": 1, "seconds": 1_000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000, "weeks": 604_800_000}


def to_milliseconds(n: Column, unit: str) -> Column:
    return n * MILLISECONDS[unit]


def from_milliseconds(ms: Column, unit: str) -> Column:
    return ms / MILLISECONDS[unit]
