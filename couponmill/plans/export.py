"""The enriched fact and the ready-to-chart aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.functions.derive import (
    FIXED_THRESHOLD,
    GAP_DAYS,
    bucket,
    day_type,
    gap_days,
    is_received,
    is_used,
    type_label,
    ym,
)
from couponmill.functions.measures import cond_count, pct, ratio, uniques
from couponmill.operators.filters import has, only_source
from couponmill.operators.ingest import project
from couponmill.operators.ordering import order_labels
from couponmill.operators.windows import share
from couponmill.params import ReportParams
from couponmill.plans.rfm import segment_counts
from couponmill.schema import ENRICHED_COLUMNS
from couponmill.session import pin
from couponmill.sources.writers import write_csv

DEFAULTS = ReportParams()


def with_derived(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """The fact with flags, buckets, labels and month."""
    return f.withColumns({
        "is_used": is_used().cast("int"),
        "is_received": is_received().cast("int"),
        "distance_bucket": bucket("distance", p.export_distance),
        "day_type": day_type("date_used"),
        "gap_days": gap_days(),
        "gap_bucket": bucket(GAP_DAYS, p.gap),
        "threshold_bucket": bucket(FIXED_THRESHOLD, p.export_threshold),
        "discount_type_cn": type_label("discount_type"),
        "year_month": ym("date_used"),
    })


def enrich(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """The 21-column enriched fact."""
    return project(with_derived(f, p), ENRICHED_COLUMNS)


CUBE_KEYS = ("source", "has_coupon", "discount_type_cn", "distance_bucket", "gap_bucket", "threshold_bucket")


def rollup_counts(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Received rows counted by every label at once.

    The label lists are short, so the result stays small whatever the fact
    holds, and four exports are sums over it: one pass instead of four.
    """
    return (
        with_derived(has(f, "date_received"), p)
        .withColumn("has_coupon", F.col("coupon_id").isNotNull())
        .groupBy(*CUBE_KEYS)
        .agg(F.sum("is_received").alias("total_count"), F.sum("is_used").alias("used_count"))
    )


def _usage(counts: DataFrame, label: str) -> DataFrame:
    summed = counts.groupBy(label).agg(
        F.sum("total_count").alias("total_count"), F.sum("used_count").alias("used_count")
    )
    return summed.withColumn("usage_rate_pct", pct("used_count", "total_count", half_even=True))


def coupon_type_of(counts: DataFrame) -> DataFrame:
    return _usage(counts.where("has_coupon"), "discount_type_cn").orderBy("discount_type_cn")


def distance_of(counts: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    rows = only_source(counts, p.offline_source)
    return order_labels(_usage(rows, "distance_bucket"), "distance_bucket", p.export_distance.order)


def gap_of(counts: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    summed = counts.groupBy("gap_bucket").agg(F.sum("total_count").alias("cnt"))
    return order_labels(share(summed, "cnt", half_even=True), "gap_bucket", p.gap.order)


def threshold_of(counts: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    rows = counts.where("has_coupon")
    return order_labels(_usage(rows, "threshold_bucket"), "threshold_bucket", p.export_threshold.order)


def export_coupon_type(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Redemption by display name of the discount type, all sources."""
    return coupon_type_of(rollup_counts(f, p))


def export_distance(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Redemption by distance bucket, offline receipts."""
    return distance_of(rollup_counts(f, p), p)


def export_gap(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Receipts by time to redemption with their share, all sources."""
    return gap_of(rollup_counts(f, p), p)


def export_threshold(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Redemption by threshold bucket of fixed reductions, all sources."""
    return threshold_of(rollup_counts(f, p), p)


def export_monthly(f: DataFrame) -> DataFrame:
    """Uses, exact users and merchants, and uses per user for every month."""
    users, merchants = uniques("user_id", "merchant_id")
    return (
        has(f, "date_used")
        .groupBy(ym("date_used").alias("year_month"))
        .agg(F.count("*").alias("used_count"), users.alias("unique_users"), merchants.alias("unique_merchants"))
        .transform(monthly_of)
    )


def monthly_of(counts: DataFrame) -> DataFrame:
    """The monthly export from its counts."""
    return counts.withColumn("avg_uses_per_user", ratio("used_count", "unique_users", half_even=True)).orderBy("year_month")


def export_day_type(f: DataFrame) -> DataFrame:
    """Uses and users on weekdays and weekends, all sources."""
    return (
        has(f, "date_used")
        .groupBy(day_type("date_used").alias("day_type"))
        .agg(F.count("*").alias("used_count"), F.count_distinct("user_id").alias("unique_users"))
        .orderBy("day_type")
    )


def export_rfm(users: DataFrame) -> DataFrame:
    """Users per segment of an RFM result and their share."""
    return share(segment_counts(users), "user_count", half_even=True).orderBy("user_segment")


def kpi_overview(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """One row of headline figures over all sources."""
    users, merchants, coupons = uniques("user_id", "merchant_id", "coupon_id")
    same_day = cond_count(gap_days() == 0)
    return (
        f.agg(
            F.count("*").alias("total_records"),
            users.alias("total_users"),
            merchants.alias("total_merchants"),
            coupons.alias("total_coupons"),
            F.count("date_received").alias("received_cnt"),
            F.count("date_used").alias("used_cnt"),
            cond_count(is_received() & is_used()).alias("redeemed_cnt"),
            same_day.alias("same_day_cnt"),
        )
        .withColumns({
            "redeemed_pct": pct("redeemed_cnt", "received_cnt"),
            "same_day_pct": pct("same_day_cnt", "received_cnt"),
            "unredeemed_pct": pct(F.col("received_cnt") - F.col("redeemed_cnt"), "received_cnt"),
        })
    )


def chart_tables(f: DataFrame, rfm_users: DataFrame | None = None, p: ReportParams = DEFAULTS) -> dict[str, DataFrame]:
    """All chart aggregates by file name, from three passes over the fact."""
    counts = pin(rollup_counts(f, p))
    tables = {
        "chart_monthly_trend": export_monthly(f),
        "chart_coupon_type": coupon_type_of(counts),
        "chart_distance": distance_of(counts, p),
        "chart_day_type": export_day_type(f),
        "chart_gap": gap_of(counts, p),
        "chart_threshold": threshold_of(counts, p),
    }
    if rfm_users is not None:
        tables["chart_rfm"] = export_rfm(rfm_users)
    return tables


def export_all(f: DataFrame, folder: str, rfm_users: DataFrame | None = None, p: ReportParams = DEFAULTS) -> list[str]:
    """Write the enriched fact and every chart aggregate as CSV."""
    write_csv(enrich(f, p), f"{folder}/transactions_enriched")
    names = []
    for name, df in chart_tables(f, rfm_users, p).items():
        write_csv(df, f"{folder}/{name}", single_file=True)
        names.append(name)
    return names
