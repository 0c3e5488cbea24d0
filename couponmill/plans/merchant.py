"""Merchant redemption reports.

The fact is reduced to one row per merchant before it meets the merchant
dimension, so a merchant that holds a third of all rows is shuffled as one row
per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponmill.functions.derive import is_received, is_used
from couponmill.functions.measures import cond_count, mean_of, pct, uniques
from couponmill.operators.filters import having, train_only
from couponmill.operators.keyed import keyed_join
from couponmill.operators.ordering import rank_top
from couponmill.params import OVERALL_SCOPE, ReportParams
from couponmill.session import pin

DEFAULTS = ReportParams()


def merchant_counts(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Rows, receipts and uses per merchant over the labelled sources.

    All merchant reports can start from one stored copy of this frame.
    """
    return train_only(f, p.training_sources).groupBy("merchant_id").agg(
        F.count("*").alias("total_records"),
        F.count("date_received").alias("received_cnt"),
        F.count("date_used").alias("used_cnt"),
        cond_count(~is_used() & is_received()).alias("unused_cnt"),
        cond_count(is_used() & is_received()).alias("redeemed_cnt"),
    )


def merchant_stats(
    counts: DataFrame, min_received: int, merchants: DataFrame | None = None, half_even: bool = False
) -> DataFrame:
    """Merchant counts with the redemption rate, for merchants with enough receipts.

    With ``merchants`` only merchants of that dimension are kept.
    """
    enough = having(counts, F.col("received_cnt") >= min_received)
    if merchants is not None:
        enough = enough.join(merchants.select("merchant_id"), "merchant_id", "inner")
    return enough.withColumn("usage_rate", pct("used_cnt", "received_cnt", half_even=half_even))


def merchant_usage(
    merchants: DataFrame,
    f: DataFrame,
    min_received: int | None = None,
    p: ReportParams = DEFAULTS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Transactions, redeemed, unredeemed and redemption rate per merchant.

    ``transaction_id`` is the key of the fact, so its distinct count is the row count.
    """
    least = p.usage_min_received if min_received is None else min_received
    return (
        merchant_stats(merchant_counts(f, p) if counts is None else counts, least, merchants)
        .select(
            "merchant_id",
            F.col("total_records").alias("total_txn"),
            F.col("used_cnt").alias("used_count"),
            F.col("unused_cnt").alias("unused_count"),
            F.col("usage_rate").alias("usage_rate_pct"),
        )
        .orderBy(F.desc("usage_rate_pct"), "merchant_id")
    )


def merchant_rank(
    merchants: DataFrame, f: DataFrame, p: ReportParams = DEFAULTS, counts: DataFrame | None = None
) -> DataFrame:
    """The merchants with the best rate under three ranking rules."""
    stats = merchant_stats(merchant_counts(f, p) if counts is None else counts, p.rank_min_received, merchants).select(
        "merchant_id",
        F.col("received_cnt").alias("total_received"),
        F.col("used_cnt").alias("total_used"),
        F.col("usage_rate").alias("usage_rate_pct"),
    )
    return (
        rank_top(stats, "-usage_rate_pct", ["merchant_id"], p.rank_top)
        .withColumnsRenamed({"rank_num": "rank_by_rate", "dense_rnk": "dense_rank_by_rate"})
        .orderBy("row_num")
    )


def merchant_rank_full(f: DataFrame, p: ReportParams = DEFAULTS, counts: DataFrame | None = None) -> DataFrame:
    """The best merchants with ranks, percent rank and decile among all merchants."""
    stats = merchant_stats(merchant_counts(f, p) if counts is None else counts, p.full_rank_min_received).select(
        "merchant_id", "received_cnt", "used_cnt", "usage_rate"
    )
    if counts is None:
        stats = pin(stats)
    return rank_top(stats, "-usage_rate", ["merchant_id"], p.full_rank_top, total=stats.count()).orderBy("row_num")


def merchants_above(f: DataFrame, rate: float, min_received: int, p: ReportParams = DEFAULTS) -> DataFrame:
    """Merchants with enough receipts whose uses per receipt exceed ``rate``."""
    counts = having(merchant_counts(f, p), F.col("received_cnt") >= min_received)
    return counts.where(F.col("used_cnt") / F.nullif("received_cnt", F.lit(0)) > rate).select("merchant_id")


def facts_of_merchants(f: DataFrame, merchants: DataFrame) -> DataFrame:
    """Fact rows of the given merchants (semi-join); an aggregated list is pinned first."""
    return keyed_join(f, pin(merchants), "merchant_id", "left_semi")


def high_rate_coupon_mix(
    f: DataFrame, p: ReportParams = DEFAULTS, merchants: DataFrame | None = None
) -> DataFrame:
    """Coupon types of the merchants with a high redemption rate, over all sources.

    One pass: every merchant and type is counted once for the rate and once for
    the mix; the rate test then runs over the few type rows of each merchant.
    With ``merchants``, only those of the dimension are reported.
    """
    training = F.col("source").isin(*p.training_sources)
    coupon = F.col("coupon_id").isNotNull()
    by_type = f.groupBy("merchant_id", "discount_type").agg(
        cond_count(training & is_received()).alias("_received"),
        cond_count(training & is_used()).alias("_used"),
        cond_count(coupon).alias("txn_count"),
        mean_of("discount_eq_rate", 4, coupon).alias("avg_eq_discount"),
        cond_count(coupon & is_used()).alias("used_cnt"),
    )
    if merchants is not None:
        by_type = by_type.join(merchants.select("merchant_id"), "merchant_id", "left_semi")
    merchant = Window.partitionBy("merchant_id")
    received, used = F.sum("_received").over(merchant), F.sum("_used").over(merchant)
    return (
        by_type.withColumns({"_r": received, "_u": used})
        .where((F.col("_r") >= p.mix_min_received) & (F.col("_u") / F.nullif("_r", F.lit(0)) > p.mix_rate_floor))
        .where("txn_count > 0")
        .select("merchant_id", "discount_type", "txn_count", "avg_eq_discount", "used_cnt")
        .orderBy("merchant_id", F.desc("txn_count"), "discount_type")
    )


def overall_stats(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """One row: distinct users, merchants and coupons, rows, receipts, uses, rate."""
    users, merchants, coupons = uniques("user_id", "merchant_id", "coupon_id")
    return (
        train_only(f, p.training_sources)
        .agg(
            users.alias("total_users"),
            merchants.alias("total_merchants"),
            coupons.alias("total_coupons"),
            F.count("*").alias("total_records"),
            F.count("date_received").alias("received_cnt"),
            F.count("date_used").alias("used_cnt"),
        )
        .select(
            F.lit(OVERALL_SCOPE).alias("scope"), "*", pct("used_cnt", "received_cnt").alias("overall_usage_rate_pct")
        )
    )
