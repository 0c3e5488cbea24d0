"""Row filters; every one is a pushable predicate."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train_only(f: DataFrame, sources: tuple[str, ...] = ("offline", "online")) -> DataFrame:
    """Rows of the labelled sources."""
    return f.where(F.col("source").isin(*sources))


def only_source(f: DataFrame, source: str) -> DataFrame:
    """Rows of one source."""
    return f.where(F.col("source") == source)


def has(f: DataFrame, *cols: str) -> DataFrame:
    """Rows where all given columns are present."""
    return f.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def in_window(f: DataFrame, c: str, start: date, end: date) -> DataFrame:
    """Rows with ``start <= c < end``."""
    return f.where((F.col(c) >= F.lit(start)) & (F.col(c) < F.lit(end)))


def ym_between(df: DataFrame, first: str, last: str, c: str = "ym") -> DataFrame:
    """Months from ``first`` to ``last``, both included."""
    return df.where(F.col(c).between(first, last))


def having(df: DataFrame, cond: Column | str) -> DataFrame:
    """Filter on the result of an aggregation."""
    return df.where(cond)
