"""Physical plans: pushdown, pruning, no cross joins, no global task over the fact."""

import re

import pytest


from couponmill.plans import bucket, catalog, export, merchant, rfm, trend
from couponmill.plans.catalog import PARAMS
from couponmill.session import ensure_checkpoint_dir
from couponmill.sources import readers, tpch, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact"))
    tpch.transactions(spark, sf_dir).write.mode("overwrite").parquet(path)
    return readers.read_fact(spark, path)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(trend.monthly_growth(stored, PARAMS))
    assert re.search(r"PushedFilters: \[.*IsNotNull\(date_used\)", text)
    assert "GreaterThanOrEqual(date_used,2000-01-01)" in text and "LessThan(date_used,2000-08-01)" in text
    assert re.search(r"In\(source, \[offline,online\]\)", text)
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert {c.split(":")[0] for c in schema.split(",")} == {"user_id", "merchant_id", "date_used", "source"}


@pytest.mark.parametrize("report, columns", [
    (lambda f: merchant.merchant_stats(merchant.merchant_counts(f, PARAMS), 50), {"merchant_id", "date_received", "date_used", "source"}),
    (lambda f: bucket.gap_distribution(f, PARAMS), {"date_received", "date_used", "source"}),
    (lambda f: rfm.rfm_inputs(f, PARAMS), {"user_id", "date_received", "date_used", "discount_man", "source"}),
    (lambda f: export.export_day_type(f), {"user_id", "date_used"}),
])
def test_only_needed_columns_are_read(stored, report, columns):
    (schema,) = set(re.findall(r"ReadSchema: struct<(.*?)>\n", plan(report(stored)) + "\n"))
    assert set(re.findall(r"(\w+):", schema)) == columns


def test_one_scan_and_partial_aggregation(stored):
    for df in (merchant.high_rate_coupon_mix(stored, PARAMS), export.rollup_counts(stored, PARAMS)):
        text = plan(df)
        assert text.count("FileScan") == 1 and "partial_" in text


def test_a_breakdown_alone_needs_one_exchange_by_label(stored):
    """Rolling up cells that were counted for one label reuses their partitioning."""
    for df in (bucket.threshold_usage(stored, PARAMS), bucket.coupon_type(stored, PARAMS)):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_single_partition_only_after_aggregation(stored):
    """Below every single-partition exchange there is a finished aggregate."""
    for df in (
        trend.monthly_growth(stored, PARAMS),
        trend.daily_moving_avg(stored, PARAMS),
        bucket.gap_distribution(stored, PARAMS),
        trend.weekly_growth(stored, PARAMS),
    ):
        lines = plan(df).splitlines()
        at = next(i for i, line in enumerate(lines) if "SinglePartition" in line)
        assert "HashAggregate" in lines[at + 1]
    assert "SinglePartition" not in plan(rfm.rfm_users(stored, PARAMS))
    assert "SinglePartition" not in plan(trend.merchant_monthly(stored, PARAMS))


def test_merchant_dimension_joins_the_aggregate(spark, sf_dir, stored):
    merchants = tpch.dimensions(spark, sf_dir)["merchants"]
    lines = plan(merchant.merchant_usage(merchants, stored, 50, PARAMS)).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    aggregate = next(i for i, line in enumerate(lines) if "HashAggregate" in line)
    assert join < aggregate


def test_checkpoint_folder_is_the_configured_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)


def test_written_fact_keeps_its_ids(spark, sf_dir, tmp_path):
    fact = tpch.transactions(spark, sf_dir)
    assert writers.sample_rows(fact, 3).count() == 3
    first, second = (sorted(map(str, fact.collect())) for _ in range(2))
    assert first == second
