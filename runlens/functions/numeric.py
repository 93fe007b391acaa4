"""Numeric helpers: rounding, safe casts, row totals, number text."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions._col import col


def dround(c: Column | str, places: int = 0) -> Column:
    """Round a double the way a binary-double engine does.

    Spark's ``round`` rounds the shortest decimal text of the double
    (``round(1.005, 2) = 1.01``); scaling by a power of ten first and rounding
    to an integer reproduces rounding of the binary value (``1.0``), the
    behaviour of the SQL the reports are written in.
    """
    c = col(c).cast("double")
    if places == 0:
        return F.round(c, 0)
    p = float(10 ** places)
    return F.round(c * F.lit(p), 0) / F.lit(p)


# Text that is a number for the report SQL: decimal or exponent notation where a
# single '_' may separate two digits ('1_000'), or inf / infinity / nan with an
# optional sign. Java float literals such as '1d' or '2f', which Spark's own cast
# accepts, are not numbers there and stay NULL.
_DIGITS = r"\d(?:_?\d)*"
_NUMERIC = rf"^\s*[+-]?({_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\s*$"
_INFINITY = r"(?i)^\s*[+-]?(inf|infinity)\s*$"
_NAN = r"(?i)^\s*[+-]?nan\s*$"


def safe_double(c: Column | str) -> Column:
    """``try_cast(x AS DOUBLE)`` over text, with the report SQL's number syntax:
    NULL instead of an error.

    Only text shaped like a number reaches the cast; everything else is NULL
    at once (the cast would reject it by catching a parse exception per row,
    several times slower on mostly non-numeric text)."""
    s = col(c).cast("string")
    return (F.when(s.rlike(_NUMERIC), F.regexp_replace(s, "_", "").try_cast("double"))
            .when(s.rlike(_INFINITY), s.try_cast("double"))
            .when(s.rlike(_NAN), F.lit(float("nan"))))


def measure(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double: a plain cast of a numeric column, the safe
    cast (NULL for what is no number) of any other."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return safe_double(name)


def row_total(cols: list[Column | str], strict: bool = True) -> Column:
    """Sum of stage columns.

    strict: NULL when any part is NULL (``a + b + c + d``).
    lenient: NULL parts count as 0 (``(a ?? 0) + (b ?? 0) + ...``).
    """
    parts = [col(c) for c in cols]
    if not strict:
        parts = [F.coalesce(p, F.lit(0)) for p in parts]
    return reduce(add, parts)


def shortfall(total: Column | str, floor: float) -> Column:
    """``max(0, floor - total)``: how far a run stayed under a floor."""
    return F.greatest(F.lit(0), F.lit(floor) - col(total))


def to_seconds(ms: Column | str, places: int = 1) -> Column:
    """Milliseconds to seconds, rounded (``ROUND(x / 1000.0, 1)``)."""
    return dround(col(ms).cast("double") / F.lit(1000.0), places)


def num_text(c: Column | str, places: int) -> Column:
    """Print a rounded number the way JavaScript does: 63.0 -> '63', 0.3444 -> '0.3444'.

    Spark prints large doubles in scientific form, so the value goes through a
    fixed-scale decimal and trailing zeros are dropped.
    """
    c = col(c)
    if places == 0:
        return c.cast("decimal(38,0)").cast("string")
    s = c.cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(s, r"\.?0+$", "")
