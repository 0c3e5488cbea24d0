"""Windows over aggregated frames.

The unpartitioned windows here are for frames bounded by the calendar or by a
label list (months, weeks, days, buckets), never for the fact itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponmill.functions.measures import pct
from couponmill.operators.ordering import sort_columns


def _window(order: str, partition: list[str] | None):
    return Window.partitionBy(*(partition or [])).orderBy(F.col(order))


def growth(
    df: DataFrame,
    value: str,
    order: str,
    partition: list[str] | None = None,
    *,
    previous: str = "previous",
    growth_pct: str = "growth_pct",
    change: str | None = None,
    following: str | None = None,
    digits: int = 2,
    half_even: bool = False,
) -> DataFrame:
    """Previous value and percentage growth, optionally change and next value."""
    w = _window(order, partition)
    difference = F.col(value) - F.col(previous)
    out = df.withColumn(previous, F.lag(value, 1).over(w))
    if following:
        out = out.withColumn(following, F.lead(value, 1).over(w))
    if change:
        out = out.withColumn(change, difference)
    return out.withColumn(growth_pct, pct(difference, previous, digits, half_even))


def running_sum(df: DataFrame, value: str, order: str, name: str, partition: list[str] | None = None) -> DataFrame:
    """Total of the rows up to and including the current one."""
    w = _window(order, partition).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def moving_avg(df: DataFrame, value: str, order: str, rows: int, name: str, digits: int = 1) -> DataFrame:
    """Mean of the last ``rows`` rows (rows, not calendar days)."""
    w = _window(order, None).rowsBetween(1 - rows, Window.currentRow)
    return df.withColumn(name, F.round(F.sum(value).over(w) / F.count(value).over(w), digits))


def rank_within(df: DataFrame, by: str, partition: list[str], name: str) -> DataFrame:
    """``rank()`` inside each group."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*partition).orderBy(*sort_columns([by]))))


def period_ends(df: DataFrame, value: str, period: str, order: str) -> DataFrame:
    """First, last, highest and mean value of each period, one row per period.

    A grouping gives what first/last value windows plus DISTINCT would, with a
    map-side combine and no sort.
    """
    return df.groupBy(period).agg(
        F.min_by(value, order).alias("first_day_count"),
        F.max_by(value, order).alias("last_day_count"),
        F.max(value).alias("peak_day_count"),
        F.avg(value).alias("avg_daily_count"),
    )


def share(df: DataFrame, count: str, name: str = "pct", digits: int = 2, half_even: bool = False) -> DataFrame:
    """Percentage of the total; ``df`` is an aggregated frame of a few labels."""
    return df.withColumn(name, pct(count, F.sum(count).over(Window.partitionBy()), digits, half_even))


def above_mean(df: DataFrame, c: str, mean: str = "mean_rate", flag: str = "above_mean") -> DataFrame:
    """Mean of a small top-k frame and whether each row reaches it.

    Values are compared as decimals, so the row order cannot change the result.
    """
    exact = F.col(c).cast("decimal(18,4)")
    everything = Window.partitionBy()
    total, rows = F.sum(exact).over(everything), F.count(exact).over(everything)
    return df.withColumns({
        mean: F.round(total / F.nullif(rows, F.lit(0)), 2),
        flag: exact * rows >= total,
    })
