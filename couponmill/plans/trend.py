"""Trends by month, week and day.

All windows here run over frames bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.functions.derive import day_type, year_week, ym
from couponmill.functions.measures import mean_of, ratio, uniques
from couponmill.operators.filters import has, in_window, train_only
from couponmill.operators.ordering import top_k
from couponmill.operators.windows import growth, moving_avg, period_ends, rank_within, running_sum
from couponmill.params import ReportParams

DEFAULTS = ReportParams()


def used_rows(f: DataFrame, p: ReportParams = DEFAULTS, windowed: bool = True) -> DataFrame:
    """Redeemed rows of the labelled sources, by default inside the date window."""
    rows = has(train_only(f, p.training_sources), "date_used")
    return in_window(rows, "date_used", p.window_start, p.window_end) if windowed else rows


def monthly_measures(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Uses, users, merchants and mean discounts per month.

    All monthly reports of the window can start from one stored copy.
    """
    users, merchants = uniques("user_id", "merchant_id")
    return used_rows(f, p).groupBy(ym("date_used").alias("ym")).agg(
        F.count("*").alias("used_count"),
        users.alias("unique_users"),
        merchants.alias("unique_merchants"),
        mean_of("discount_eq_rate", 4).alias("avg_discount_rate"),
        mean_of("discount_man", 2, F.col("discount_type") == "fixed").alias("avg_fixed_threshold"),
    )


def monthly_counts(f: DataFrame, p: ReportParams = DEFAULTS, monthly: DataFrame | None = None) -> DataFrame:
    """Uses, users and merchants per month."""
    measures = monthly_measures(f, p) if monthly is None else monthly
    return measures.select("ym", "used_count", "unique_users", "unique_merchants")


def monthly_growth(f: DataFrame, p: ReportParams = DEFAULTS, monthly: DataFrame | None = None) -> DataFrame:
    """Monthly uses with previous and next month, growth and running total."""
    out = growth(
        monthly_counts(f, p, monthly),
        "used_count",
        "ym",
        previous="prev_month_used",
        change="mom_change",
        growth_pct="mom_growth_pct",
        following="next_month_used",
    )
    return (
        running_sum(out, "used_count", "ym", "cumulative_used")
        .select(
            "ym", "used_count", "unique_users", "unique_merchants", "prev_month_used",
            "mom_change", "mom_growth_pct", "next_month_used", "cumulative_used",
        )
        .orderBy("ym")
    )


def merchant_monthly(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Monthly uses of every merchant with growth and the rank of the month."""
    counts = used_rows(f, p).groupBy("merchant_id", ym("date_used").alias("ym")).agg(F.count("*").alias("used_count"))
    out = growth(
        counts, "used_count", "ym", ["merchant_id"], previous="prev_month", growth_pct="mom_growth_pct"
    )
    return rank_within(out, "-used_count", ["merchant_id"], "month_rank")


def merchant_monthly_growth(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """The first rows of ``merchant_monthly`` by merchant and month."""
    return top_k(merchant_monthly(f, p), ["merchant_id", "ym"], p.growth_top)


def daily_moving_avg(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Daily uses with the mean of the last 7 and 30 days that have any."""
    daily = used_rows(f, p, windowed=False).groupBy("date_used").agg(F.count("*").alias("daily_used"))
    out = moving_avg(daily, "daily_used", "date_used", 7, "ma_7d")
    return moving_avg(out, "daily_used", "date_used", 30, "ma_30d").orderBy("date_used")


def month_first_last(f: DataFrame) -> DataFrame:
    """First, last, peak and mean daily uses per month, over all sources."""
    daily = (
        has(f, "date_used")
        .groupBy("date_used")
        .agg(F.count("*").alias("daily_count"))
        .withColumn("ym", ym("date_used"))
    )
    return period_ends(daily, "daily_count", "ym", "date_used").orderBy("ym")


def monthly_trend(f: DataFrame, p: ReportParams = DEFAULTS, monthly: DataFrame | None = None) -> DataFrame:
    """Monthly uses, users, merchants, uses per user and mean discounts."""
    first_day = F.to_date("ym", "yyyy-MM")
    return (
        (monthly_measures(f, p) if monthly is None else monthly)
        .select(
            "ym", F.year(first_day).alias("year_num"), F.month(first_day).alias("month_num"), "used_count", "unique_users", "unique_merchants",
            ratio("used_count", "unique_users").alias("avg_uses_per_user"),
            "avg_discount_rate", "avg_fixed_threshold",
        )
        .orderBy("ym")
    )


def weekly_growth(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """ISO weeks with first and last day, uses, users and growth."""
    weekly = used_rows(f, p).groupBy(year_week("date_used").alias("yw")).agg(
        F.min("date_used").alias("week_start"),
        F.max("date_used").alias("week_end"),
        F.count("*").alias("used_count"),
        F.count_distinct("user_id").alias("unique_users"),
    )
    return growth(
        weekly, "used_count", "yw", previous="prev_week_used", growth_pct="wow_growth_pct"
    ).orderBy("yw")


def day_type_usage(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Uses, users, mean discount and uses per day on weekdays and weekends."""
    users, days = uniques("user_id", "date_used")
    return (
        used_rows(f, p, windowed=False)
        .groupBy(day_type("date_used").alias("day_type"))
        .agg(
            F.count("*").alias("used_count"),
            users.alias("unique_users"),
            mean_of("discount_eq_rate", 4).alias("avg_discount"),
            days.alias("_days"),
        )
        .select(
            "day_type", "used_count", "unique_users", "avg_discount",
            ratio("used_count", "_days", 0).alias("avg_daily_uses"),
        )
    )
