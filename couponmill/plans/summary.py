"""Pre-aggregated tables, to be materialised once and queried often."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.functions.measures import pct
from couponmill.operators.filters import having
from couponmill.params import ReportParams
from couponmill.plans.bucket import coupon_type, gap_counts, plain_threshold_usage, usage_cube
from couponmill.plans.merchant import merchant_counts
from couponmill.plans.rfm import rfm_inputs
from couponmill.plans.trend import monthly_counts, monthly_measures
from couponmill.session import pin, stage
from couponmill.sources.readers import data_mark, summary_or_compute
from couponmill.sources.writers import materialize, replace_table

DEFAULTS = ReportParams()


def summary_merchant_usage(f: DataFrame, p: ReportParams = DEFAULTS, counts: DataFrame | None = None) -> DataFrame:
    """Redemption per merchant over received rows only, so no rate exceeds 100."""
    received = (merchant_counts(f, p) if counts is None else counts).select(
        "merchant_id", F.col("received_cnt").alias("total_received"), F.col("redeemed_cnt").alias("used_count")
    )
    return (
        having(received, F.col("total_received") >= p.summary_min_received)
        .withColumn("usage_rate_pct", pct("used_count", "total_received"))
        .orderBy(F.desc("usage_rate_pct"), "merchant_id")
    )


def summary_monthly_trend(f: DataFrame, p: ReportParams = DEFAULTS, monthly: DataFrame | None = None) -> DataFrame:
    """Uses, users and merchants per month of the window."""
    return monthly_counts(f, p, monthly).orderBy("ym")


def summary_coupon_type(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption and mean discounts by discount type."""
    return coupon_type(f, p, cube).drop("unused_count")


def summary_rfm_scores(f: DataFrame, p: ReportParams = DEFAULTS, inputs: DataFrame | None = None) -> DataFrame:
    """Recency, frequency and monetary inputs of every redeeming user."""
    return (rfm_inputs(f, p) if inputs is None else inputs).drop("mean_threshold")


def summary_threshold_bucket(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption by threshold bucket with plain-text labels."""
    return plain_threshold_usage(f, p, cube)


def summary_gap_analysis(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Receipts by time to redemption."""
    return gap_counts(f, p, cube)


SUMMARIES: dict[str, Callable[..., DataFrame]] = {
    fn.__name__: fn
    for fn in (
        summary_merchant_usage,
        summary_monthly_trend,
        summary_coupon_type,
        summary_rfm_scores,
        summary_threshold_bucket,
        summary_gap_analysis,
    )
}


def parameter_mark(p: ReportParams) -> str:
    """The same text for equal parameters only."""
    return hashlib.sha256(repr(p).encode()).hexdigest()


def bound_mark(f: DataFrame, p: ReportParams = DEFAULTS) -> str:
    """The same text for equal parameters over the same files of the fact only."""
    return f"{parameter_mark(p)}:{data_mark(f)}"


def shared(f: DataFrame, p: ReportParams = DEFAULTS) -> dict[str, Callable[[], dict[str, DataFrame]]]:
    """What gives the stored aggregates each summary starts from, by summary name.

    The cube, the merchant counts, the user inputs and the months are each
    computed when first asked for and then kept, so all summaries together read the
    fact four times, and a summary that is not asked for costs nothing.
    """
    cube = cache(lambda: {"cube": pin(usage_cube(f, p))})
    return {
        "summary_merchant_usage": cache(lambda: {"counts": stage(merchant_counts(f, p))}),
        "summary_monthly_trend": cache(lambda: {"monthly": pin(monthly_measures(f, p))}),
        "summary_coupon_type": cube,
        "summary_rfm_scores": cache(lambda: {"inputs": stage(rfm_inputs(f, p))}),
        "summary_threshold_bucket": cube,
        "summary_gap_analysis": cube,
    }


def build_summaries(f: DataFrame, p: ReportParams = DEFAULTS) -> dict[str, int]:
    """Write all summary tables; returns the rows of each."""
    given, mark = shared(f, p), bound_mark(f, p)
    return {name: replace_table(fn(f, p, **given[name]()), name, mark=mark) for name, fn in SUMMARIES.items()}


def materialize_summary(f: DataFrame, name: str, p: ReportParams = DEFAULTS) -> DataFrame:
    """Write one summary table and read it back."""
    return materialize(SUMMARIES[name](f, p), name, bound_mark(f, p))


def current_summary(f: DataFrame, name: str, p: ReportParams = DEFAULTS) -> DataFrame:
    """The stored summary if it was built with these parameters from the files ``f`` reads now, else computed anew."""
    return summary_or_compute(f.sparkSession, name, lambda: SUMMARIES[name](f, p), bound_mark(f, p))
