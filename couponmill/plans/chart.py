"""Data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.functions.derive import rfm_segment, type_label, ym
from couponmill.functions.measures import pct
from couponmill.operators.filters import ym_between
from couponmill.operators.ordering import quantile_bin, quantile_edges, top_k
from couponmill.operators.windows import above_mean, growth, share
from couponmill.params import CHART_TYPE_LABELS, RFM_FALLBACK_SCORE, RFM_TILES, ReportParams
from couponmill.plans.bucket import coupon_type
from couponmill.plans.merchant import merchant_counts, merchant_stats
from couponmill.plans.rfm import rfm_inputs, segment_counts
from couponmill.plans.trend import used_rows
from couponmill.session import stage

DEFAULTS = ReportParams()


def top_merchants_chart(f: DataFrame, p: ReportParams = DEFAULTS, counts: DataFrame | None = None) -> DataFrame:
    """The merchants with the best rate, their mean rate, and who reaches it."""
    rated = merchant_stats(merchant_counts(f, p) if counts is None else counts, p.chart_min_received, half_even=True).select(
        "merchant_id", "received_cnt", "used_cnt", F.col("usage_rate").alias("usage_rate_pct")
    )
    top = top_k(rated, ["-usage_rate_pct", "merchant_id"], p.chart_top)
    return above_mean(top, "usage_rate_pct").orderBy(F.desc("usage_rate_pct"), "merchant_id")


def rfm_distribution_chart(
    f: DataFrame, p: ReportParams = DEFAULTS, compat: bool = False, inputs: DataFrame | None = None
) -> DataFrame:
    """Users per segment from recency and frequency bins; both scores are 3 if either fails."""
    users = (stage(rfm_inputs(f, p).select("user_id", "frequency", "recency_days")) if inputs is None else inputs)
    edges = quantile_edges(users, ["recency_days", "frequency"], ["user_id"], RFM_TILES)
    r = quantile_bin("recency_days", edges["recency_days"], None)
    r = r if compat else RFM_TILES + 1 - r
    f_bin = quantile_bin("frequency", edges["frequency"], None)
    failed = r.isNull() | f_bin.isNull()
    fallback = F.lit(RFM_FALLBACK_SCORE)
    scored = users.select(
        F.when(failed, fallback).otherwise(r).alias("r_score"),
        F.when(failed, fallback).otherwise(f_bin).alias("f_score"),
    )
    counted = segment_counts(scored.select(rfm_segment().alias("segment")), "segment")
    return share(counted, "user_count", digits=1).orderBy(F.desc("user_count"), "segment")


def monthly_chart(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Monthly uses and users with signed growth labels."""
    monthly = (
        used_rows(f, p, windowed=False)
        .groupBy(ym("date_used").alias("ym"))
        .agg(F.count("user_id").alias("used_count"), F.count_distinct("user_id").alias("unique_users"))
    )
    shown = ym_between(monthly, p.chart_first_month, p.chart_last_month)
    out = growth(
        shown, "used_count", "ym", previous="prev", growth_pct="mom_pct", digits=1, half_even=True
    )
    label = F.when(F.col("mom_pct").isNotNull(), F.format_string("%+.1f%%", "mom_pct"))
    return out.withColumns({"is_rise": F.col("mom_pct") > 0, "mom_label": label}).orderBy("ym")


def growth_points(monthly: DataFrame) -> DataFrame:
    """The months of the growth line: those with a previous month."""
    return monthly.dropna(subset=["mom_pct"])


def coupon_type_chart(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption by discount type with its display name."""
    return (
        coupon_type(f, p, cube)
        .select(
            "discount_type", "total_count", "used_count",
            pct("used_count", "total_count", half_even=True).alias("usage_rate_pct"),
            type_label("discount_type", CHART_TYPE_LABELS, default="discount_type").alias("label"),
        )
        .orderBy(F.desc("usage_rate_pct"), "discount_type")
    )
