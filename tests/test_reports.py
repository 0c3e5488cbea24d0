"""Every registered query against its SQL, and invariants between reports."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from couponmill.plans import bucket, catalog, chart, export, merchant, rfm, trend
from couponmill.plans.catalog import PARAMS
from couponmill.sources import tpch
from sqlcheck import compare, oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return tpch.events(spark, sf_dir).cache()


def test_both_sides_are_registered():
    assert set(catalog.QUERIES) == set(oracle.queries())
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare.difference(spark, sf_dir, con, catalog.QUERIES[name], oracle.queries()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_partitions_of_the_same_rows_agree(events):
    received = events.where("date_received IS NOT NULL AND coupon_id IS NOT NULL")
    rows, used = received.count(), received.where("date_used IS NOT NULL").count()
    for report, total in (
        (export.export_coupon_type(events), "total_count"),
        (export.export_threshold(events, PARAMS), "total_count"),
    ):
        assert report.agg(F.sum(total), F.sum("used_count")).first() == (rows, used)
    gap = export.export_gap(events, PARAMS).collect()
    assert sum(r.cnt for r in gap) == rows and abs(sum(r.pct for r in gap) - 100) < 0.05
    assert sum(r.cnt for r in gap if r.gap_bucket != "未核销") == used


def test_training_buckets_sum_to_training_rows(events):
    rows = events.where("source <> 'offline_test' AND coupon_id IS NOT NULL AND date_received IS NOT NULL").count()
    assert bucket.threshold_usage(events, PARAMS).agg(F.sum("total_cnt")).first()[0] == rows
    assert bucket.coupon_type(events, PARAMS).agg(F.sum("total_count")).first()[0] == rows


def test_running_total_ends_at_the_total(events):
    rows = trend.monthly_growth(events, PARAMS).collect()
    assert rows[-1].cumulative_used == sum(r.used_count for r in rows) == trend.used_rows(events, PARAMS).count()
    assert [r.next_month_used for r in rows[:-1]] == [r.used_count for r in rows[1:]]


def test_uniques_never_exceed_uses(events):
    for r in export.export_monthly(events).collect():
        assert r.unique_users <= r.used_count and r.unique_merchants <= r.used_count
        assert r.avg_uses_per_user >= 1


def test_tiles_are_even(events):
    users = rfm.rfm_users(events, PARAMS).collect()
    for score in ("r_score", "f_score", "m_score"):
        sizes = [sum(u[score] == s for u in users) for s in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(users)
    best = [u for u in users if u.r_score == 5]
    rest = [u for u in users if u.r_score < 5]
    assert max(u.recency_days for u in best) <= min(u.recency_days for u in rest)


def test_segment_counts_cover_all_users(events):
    segments = rfm.rfm_segments(events, PARAMS).collect()
    assert sum(r.user_count for r in segments) == rfm.rfm_inputs(events, PARAMS).count()
    assert abs(sum(r.pct for r in segments) - 100) < 0.05


def test_compat_inverts_recency_only(events):
    ours = {r.user_id: r for r in rfm.rfm_qcut(events, PARAMS).collect()}
    for r in rfm.rfm_qcut(events, PARAMS, compat=True).collect():
        assert r.r_score == 6 - ours[r.user_id].r_score
        assert (r.f_score, r.m_score) == (ours[r.user_id].f_score, ours[r.user_id].m_score)


def test_one_pass_mix_equals_semi_join(events):
    above = merchant.merchants_above(events, PARAMS.mix_rate_floor, PARAMS.mix_min_received, PARAMS)
    rows = merchant.facts_of_merchants(events, above).where("coupon_id IS NOT NULL")
    want = rows.groupBy("merchant_id", "discount_type").agg(F.count("*").alias("n"), F.count("date_used").alias("u"))
    got = merchant.high_rate_coupon_mix(events, PARAMS).select("merchant_id", "discount_type", "txn_count", "used_cnt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reports_on_no_rows(events):
    none = events.where("user_id < 0")
    assert trend.monthly_growth(none, PARAMS).collect() == []
    assert bucket.gap_distribution(none, PARAMS).collect() == []
    assert rfm.rfm_users(none, PARAMS).collect() == []
    assert rfm.rfm_qcut(none, PARAMS).collect() == []
    assert merchant.merchant_rank_full(none, PARAMS).collect() == []
    assert chart.rfm_distribution_chart(none, PARAMS).collect() == []
    row = merchant.overall_stats(none, PARAMS).first()
    assert row.total_records == 0 and row.overall_usage_rate_pct is None


def test_growth_points_drop_the_first_month(events):
    months = chart.monthly_chart(events, PARAMS)
    assert chart.growth_points(months).count() == months.count() - 1


def test_export_all(spark, events, tmp_path):
    users = rfm.rfm_view(events, PARAMS)
    names = export.export_all(events, str(tmp_path), users, PARAMS)
    assert len(names) == 7
    for name in names:
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() > 0
    enriched = spark.read.option("header", True).csv(f"{tmp_path}/transactions_enriched")
    assert enriched.count() == events.count() and len(enriched.columns) == 21


def test_reports_from_shared_aggregates_equal_single_reports(events, spark, sf_dir):
    cube = bucket.usage_cube(events, PARAMS).cache()
    for report in (
        bucket.coupon_type, bucket.threshold_usage, bucket.plain_threshold_usage, bucket.distance_usage,
        bucket.gap_distribution, chart.coupon_type_chart,
    ):
        assert sorted(report(events, PARAMS, cube=cube).collect()) == sorted(report(events, PARAMS).collect())
    counts = merchant.merchant_counts(events, PARAMS).cache()
    for report in (merchant.merchant_rank_full, chart.top_merchants_chart):
        assert report(events, PARAMS, counts=counts).collect() == report(events, PARAMS).collect()
    inputs = rfm.rfm_inputs(events, PARAMS).cache()
    scored = rfm.rfm_scored(inputs)
    for report in (rfm.rfm_users, rfm.rfm_segments):
        assert report(events, PARAMS, scored=scored).collect() == report(events, PARAMS).collect()
    for report in (rfm.rfm_qcut_segments, chart.rfm_distribution_chart):
        assert report(events, PARAMS, inputs=inputs).collect() == report(events, PARAMS).collect()


def test_exports_from_one_pass_equal_single_reports(events):
    tables = export.chart_tables(events, p=PARAMS)
    for name, report in (
        ("chart_coupon_type", export.export_coupon_type(events, PARAMS)),
        ("chart_distance", export.export_distance(events, PARAMS)),
        ("chart_gap", export.export_gap(events, PARAMS)),
        ("chart_threshold", export.export_threshold(events, PARAMS)),
    ):
        assert tables[name].collect() == report.collect()
