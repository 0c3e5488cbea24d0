"""Time the headline reports; prints one JSON line.

The fact is built from the tables once, stored as a star schema's fact is, and every
report then reads it.  ``build_fact`` is the cost of joining, cleaning, numbering and
sorting.  Reports run BENCH_RUNS times each, uncached, and the median counts; a
small generic job first starts the engine and is reported apart as ``warmup``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from couponmill.operators import integrity, ordering, star  # noqa: E402
from couponmill.plans import bucket, chart, export, merchant, rfm, summary, trend  # noqa: E402
from couponmill.plans.catalog import PARAMS, remaining  # noqa: E402
from couponmill.session import build_session  # noqa: E402
from couponmill.sources import tpch, writers  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def reports(f, merchants, left):
    p = PARAMS
    stats = merchant.merchant_stats(merchant.merchant_counts(f, p), p.full_rank_min_received)
    return {
        "merchant_usage": lambda: merchant.merchant_usage(merchants, f, p=p),
        "merchant_rank": lambda: merchant.merchant_rank(merchants, f, p),
        "merchant_rank_full": lambda: merchant.merchant_rank_full(f, p),
        "high_rate_coupon_mix": lambda: merchant.high_rate_coupon_mix(f, p),
        "overall_stats": lambda: merchant.overall_stats(f, p),
        "monthly_growth": lambda: trend.monthly_growth(f, p),
        "merchant_monthly_growth": lambda: trend.merchant_monthly_growth(f, p),
        "daily_moving_avg": lambda: trend.daily_moving_avg(f, p),
        "month_first_last": lambda: trend.month_first_last(f),
        "monthly_trend": lambda: trend.monthly_trend(f, p),
        "weekly_growth": lambda: trend.weekly_growth(f, p),
        "day_type_usage": lambda: trend.day_type_usage(f, p),
        "coupon_type": lambda: bucket.coupon_type(f, p),
        "threshold_usage": lambda: bucket.threshold_usage(f, p),
        "distance_usage": lambda: bucket.distance_usage(f, p),
        "gap_distribution": lambda: bucket.gap_distribution(f, p),
        "summary_merchant_usage": lambda: summary.summary_merchant_usage(f, p),
        "rfm_users": lambda: rfm.rfm_users(f, p),
        "rfm_segments": lambda: rfm.rfm_segments(f, p),
        "rfm_qcut_segments": lambda: rfm.rfm_qcut_segments(f, p),
        "top_merchants_chart": lambda: chart.top_merchants_chart(f, p),
        "monthly_chart": lambda: chart.monthly_chart(f, p),
        "enriched": lambda: export.enrich(f, p),
        "rollup_counts": lambda: export.rollup_counts(f, p),
        "export_monthly": lambda: export.export_monthly(f),
        "kpi_overview": lambda: export.kpi_overview(f, p),
        "rfm_qcut": lambda: rfm.rfm_qcut(f, p),
        "merchant_rank_all": lambda: ordering.rank_all(stats, "-usage_rate", ["merchant_id"]),
        "dim_coupons": lambda: star.coupon_dimension(f),
        "orphan_report": lambda: integrity.orphan_report(f, left),
        "cascade_delete": lambda: integrity.cascade(f, *left["merchants"]),
        "set_null_missing": lambda: integrity.set_null_missing(f, *left["coupons"]),
    }


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    started = time.time()
    run(spark.range(100_000).groupBy((F.col("id") % 100).cast("string").alias("k")).count().orderBy("k"))
    warmup = round(time.time() - started, 3)
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        started = time.time()
        writers.save_fact(tpch.transactions(spark, SF_DIR), folder)
        seconds["build_fact"] = round(time.time() - started, 3)
        fact = writers.load_fact(spark, folder)
        rows = fact.count()
        merchants, left = tpch.dimensions(spark, SF_DIR)["merchants"], remaining(spark, SF_DIR)
        for name, report in reports(fact, merchants, left).items():
            runs = []
            for _ in range(RUNS):
                started = time.time()
                run(report())
                runs.append(time.time() - started)
            seconds[name] = round(median(runs), 3)
        spark.stop()
    print(
        json.dumps({
            "metric": "promotion report suite, total wall time",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": float(Path(SF_DIR).name.removeprefix("sf")),
            "fact_rows": rows,
            "cpus": int(CPUS),
            "runs": RUNS,
            "warmup": warmup,
        })
    )


if __name__ == "__main__":
    main()
