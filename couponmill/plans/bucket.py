"""Breakdowns by discount type, threshold, distance and time to redemption.

Each report rolls up cells counted by label.  Alone it counts only the cells it
needs; several reports can share one ``usage_cube``, which reads the fact once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponmill.functions.derive import GAP_DAYS, bucket
from couponmill.functions.measures import pct
from couponmill.operators.filters import has, train_only
from couponmill.operators.ordering import order_labels
from couponmill.operators.windows import share
from couponmill.params import EXPORT_THRESHOLD, ReportParams

DEFAULTS = ReportParams()

# Means offered per label: value column and digits.
MEANS = {"eq": ("discount_eq_rate", 4), "man": ("discount_man", 2), "jian": ("discount_jian", 2)}


def labels(p: ReportParams = DEFAULTS) -> dict[str, Column]:
    """The label columns of the cube."""
    return {
        "discount_type": F.col("discount_type"),
        "threshold_bucket": bucket("discount_man", p.threshold),
        "plain_threshold_bucket": bucket("discount_man", EXPORT_THRESHOLD),
        "distance_bucket": bucket("distance", p.distance),
        "gap_bucket": bucket(GAP_DAYS, p.gap),
    }


def _measured(rows: DataFrame, keys: list[Column]) -> DataFrame:
    sums = [F.sum(c).alias(f"{name}_sum") for name, (c, _) in MEANS.items()]
    counts = [F.count(c).alias(f"{name}_n") for name, (c, _) in MEANS.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count("date_used").alias("used"), *sums, *counts)


def usage_cube(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Received rows counted by source and every label; small whatever the fact holds."""
    keys = [F.col("source"), F.col("coupon_id").isNotNull().alias("has_coupon")]
    return _measured(has(f, "date_received"), keys + [c.alias(n) for n, c in labels(p).items()])


def _cells(
    f: DataFrame, label: str, p: ReportParams, cube: DataFrame | None, sources: tuple[str, ...], coupons: bool
) -> DataFrame:
    """Cells of the given sources by one label, from the cube or counted for this label only."""
    if cube is not None:
        cells = train_only(cube, sources)
        return cells.where("has_coupon") if coupons else cells
    rows = has(train_only(f, sources), "date_received", *(["coupon_id"] if coupons else []))
    return _measured(rows, [labels(p)[label].alias(label)])


def _rolled(cells: DataFrame, label: str, total: str, used: str, means: dict[str, str] | None = None) -> DataFrame:
    """Rows, redeemed rows, redemption rate and the wanted means per label."""
    wanted = means or {}
    summed = cells.groupBy(label).agg(
        F.sum("total").alias(total),
        F.sum("used").alias(used),
        *[F.sum(f"{name}_{part}").alias(f"{name}_{part}") for name in wanted.values() for part in ("sum", "n")],
    )
    averages = [
        F.round(F.col(f"{name}_sum") / F.nullif(f"{name}_n", F.lit(0)), MEANS[name][1]).alias(alias)
        for alias, name in wanted.items()
    ]
    return summed.select(label, total, used, pct(used, total).alias("usage_rate_pct"), *averages)


def coupon_type(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption and mean discounts by discount type."""
    cells = _cells(f, "discount_type", p, cube, p.training_sources, coupons=True)
    means = {"avg_eq_rate": "eq", "avg_threshold": "man", "avg_reduction": "jian"}
    return (
        _rolled(cells, "discount_type", "total_count", "used_count", means)
        .select(
            "discount_type", "total_count", "used_count",
            (F.col("total_count") - F.col("used_count")).alias("unused_count"),
            "usage_rate_pct", *means,
        )
        .orderBy(F.desc("usage_rate_pct"), "discount_type")
    )


def coupon_type_short(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption and mean rate by discount type."""
    return coupon_type(f, p, cube).select("discount_type", "total_count", "used_count", "usage_rate_pct", "avg_eq_rate")


def _threshold(f: DataFrame, label: str, p: ReportParams, cube: DataFrame | None) -> DataFrame:
    cells = _cells(f, label, p, cube, p.training_sources, coupons=True)
    return _rolled(cells, label, "total_cnt", "used_cnt", {"avg_eq_discount": "eq"}).withColumnRenamed(
        label, "threshold_bucket"
    )


def threshold_usage(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption by threshold bucket in label order."""
    return order_labels(_threshold(f, "threshold_bucket", p, cube), "threshold_bucket", p.threshold.order)


def plain_threshold_usage(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption by threshold bucket with plain-text labels, unsorted."""
    return _threshold(f, "plain_threshold_bucket", p, cube)


def distance_usage(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Redemption by distance bucket, offline receipts only."""
    cells = _cells(f, "distance_bucket", p, cube, (p.offline_source,), coupons=False)
    return _rolled(cells, "distance_bucket", "total_cnt", "used_cnt").orderBy(
        F.desc("usage_rate_pct"), "distance_bucket"
    )


def gap_counts(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Receipts by time to redemption, unsorted."""
    cells = _cells(f, "gap_bucket", p, cube, p.training_sources, coupons=False)
    return cells.groupBy("gap_bucket").agg(F.sum("total").alias("cnt"))


def gap_distribution(f: DataFrame, p: ReportParams = DEFAULTS, cube: DataFrame | None = None) -> DataFrame:
    """Receipts by time to redemption with their share, in label order."""
    return order_labels(share(gap_counts(f, p, cube), "cnt"), "gap_bucket", p.gap.order)
