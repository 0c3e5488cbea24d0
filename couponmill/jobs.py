"""Command line: raw logs to star schema, tables, reports and chart data.

    python -m couponmill.jobs build  --online P --offline P --test P --star DIR
    python -m couponmill.jobs load   --star DIR
    python -m couponmill.jobs report --star DIR --out DIR
    python -m couponmill.jobs export --star DIR --out DIR
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from couponmill.operators.ingest import build_fact
from couponmill.operators.star import Star, star_of
from couponmill.params import ReportParams
from couponmill.plans import bucket, chart, export, liveview, merchant, rfm, summary, trend
from couponmill.session import Scratch, build_session, stage
from couponmill.sources import readers, writers


def build(spark: SparkSession, online: str, offline: str, test: str, folder: str) -> Star:
    """Clean the raw logs into a star schema under ``folder``.

    The fact is written first and the dimensions come from the written fact;
    the numbered copy of the logs made on the way is removed.
    """
    paths = {"online": online, "offline": offline, "offline_test": test}
    work = Scratch(spark)
    fact = build_fact(*(readers.read_raw(spark, path, kind) for kind, path in paths.items()), put=work.stage)
    writers.save_fact(fact, folder)
    work.remove()
    writers.save_dimensions(star_of(writers.load_fact(spark, folder)), folder)
    return writers.load_star(spark, folder)


def load(star: Star, p: ReportParams) -> dict[str, int]:
    """Replace the four tables, dimensions first, then the RFM view and the summary tables."""
    rows = {r["table_name"]: r["row_count"] for r in writers.load_tables(star.tables()).collect()}
    liveview.register_live_rfm_view(star.transactions.sparkSession, "transactions", p=p)
    return {**rows, **summary.build_summaries(star.transactions, p)}


def all_reports(star: Star, p: ReportParams) -> dict[str, Callable[[], DataFrame]]:
    """Every report by name; a summary stored with the same parameters from the same files is read from there.

    Merchant counts, months, user inputs and scores, and the label cube are
    computed once, when first needed, and shared.
    """
    f, merchants, spark = star.transactions, star.merchants, star.transactions.sparkSession
    shared, mark = summary.shared(f, p), summary.bound_mark(f, p)
    counts = lambda: shared["summary_merchant_usage"]()["counts"]
    monthly = lambda: shared["summary_monthly_trend"]()["monthly"]
    inputs = lambda: shared["summary_rfm_scores"]()["inputs"]
    cube = lambda: shared["summary_coupon_type"]()["cube"]
    scored = cache(lambda: rfm.rfm_scored(inputs()))

    def stored(name: str) -> Callable[[], DataFrame]:
        compute = lambda: summary.SUMMARIES[name](f, p, **shared[name]())
        return lambda: readers.summary_or_compute(spark, name, compute, mark)

    return {
        "table_counts": lambda: writers.table_counts(star.tables()),
        "overall_stats": lambda: merchant.overall_stats(f, p),
        "merchant_usage": lambda: merchant.merchant_usage(merchants, f, p=p, counts=counts()),
        "merchant_rank": lambda: merchant.merchant_rank(merchants, f, p, counts()),
        "merchant_rank_full": lambda: merchant.merchant_rank_full(f, p, counts()),
        "high_rate_coupon_mix": lambda: merchant.high_rate_coupon_mix(f, p),
        "monthly_growth": lambda: trend.monthly_growth(f, p, monthly()),
        "merchant_monthly_growth": lambda: trend.merchant_monthly_growth(f, p),
        "daily_moving_avg": lambda: trend.daily_moving_avg(f, p),
        "month_first_last": lambda: trend.month_first_last(f),
        "monthly_trend": lambda: trend.monthly_trend(f, p, monthly()),
        "weekly_growth": lambda: trend.weekly_growth(f, p),
        "day_type_usage": lambda: trend.day_type_usage(f, p),
        "coupon_type": lambda: bucket.coupon_type(f, p, cube()),
        "threshold_usage": lambda: bucket.threshold_usage(f, p, cube()),
        "distance_usage": lambda: bucket.distance_usage(f, p, cube()),
        "gap_distribution": lambda: bucket.gap_distribution(f, p, cube()),
        **{name: stored(name) for name in summary.SUMMARIES},
        "rfm_users": lambda: rfm.rfm_users(f, p, scored()),
        "rfm_segments": lambda: rfm.rfm_segments(f, p, scored()),
        "rfm_qcut": lambda: rfm.rfm_qcut(f, p, inputs=inputs()),
        "rfm_qcut_segments": lambda: rfm.rfm_qcut_segments(f, p, inputs=inputs()),
        "top_merchants_chart": lambda: chart.top_merchants_chart(f, p, counts()),
        "rfm_distribution_chart": lambda: chart.rfm_distribution_chart(f, p, inputs=inputs()),
        "monthly_chart": lambda: chart.monthly_chart(f, p),
        "coupon_type_chart": lambda: chart.coupon_type_chart(f, p, cube()),
        "kpi_overview": lambda: export.kpi_overview(f, p),
    }


# Reports with a row per user or merchant stay in several files.
LARGE = {"merchant_usage", "high_rate_coupon_mix", "summary_merchant_usage", "summary_rfm_scores", "rfm_users", "rfm_qcut"}


def report(star: Star, out: str, p: ReportParams) -> list[str]:
    """Write every report as CSV under ``out``."""
    reports = all_reports(star, p)
    for name, plan in reports.items():
        writers.write_csv(plan(), f"{out}/{name}", single_file=name not in LARGE)
    return list(reports)


def export_charts(star: Star, out: str, p: ReportParams) -> list[str]:
    """Write the enriched fact and the chart aggregates as CSV under ``out``."""
    users = stage(rfm.rfm_view(star.transactions, p))
    return export.export_all(star.transactions, out, users, p)


def main(argv: list[str] | None = None, p: ReportParams = ReportParams()) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["build", "load", "report", "export"])
    for option in ("--online", "--offline", "--test", "--out"):
        parser.add_argument(option)
    parser.add_argument("--star", required=True)
    args = parser.parse_args(argv)
    spark = build_session("couponmill")
    if args.job == "build":
        build(spark, args.online, args.offline, args.test, args.star)
        return
    star = writers.load_star(spark, args.star)
    if args.job == "load":
        load(star, p)
    elif args.job == "report":
        report(star, args.out, p)
    else:
        export_charts(star, args.out, p)


if __name__ == "__main__":
    main()
