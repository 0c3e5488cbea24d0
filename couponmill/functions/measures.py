"""Aggregate and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cond_count(cond: Column) -> Column:
    """Rows of the group for which ``cond`` holds."""
    return F.count_if(cond)


def uniques(*cols: Column | str) -> list[Column]:
    """Exact distinct count of each expression."""
    return [F.count_distinct(_col(c)) for c in cols]


def mean_of(c: Column | str, digits: int, cond: Column | None = None) -> Column:
    """Mean of the non-NULL values (those meeting ``cond``), rounded half up.

    Sum over count keeps decimals exact up to the final rounding.
    """
    value = _col(c) if cond is None else F.when(cond, _col(c))
    return F.round(F.sum(value) / F.nullif(F.count(value), F.lit(0)), digits)


def pct(part: Column | str, whole: Column | str, digits: int = 2, half_even: bool = False) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return ratio(_col(part) * F.lit(100), whole, digits, half_even)


def ratio(part: Column | str, whole: Column | str, digits: int = 2, half_even: bool = False) -> Column:
    """Rounded quotient of two counts; NULL when ``whole`` is zero."""
    quotient = _col(part) / F.nullif(_col(whole), F.lit(0))
    return F.bround(quotient, digits) if half_even else F.round(quotient, digits)
