"""The command line, from raw logs to written reports."""

import glob

import pytest

from couponmill import jobs
from couponmill.plans import catalog, merchant, trend
from couponmill.sources import tpch, writers


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("jobs"))
    raw = catalog.write_raw_logs(spark, sf_dir, f"{root}/raw")
    jobs.main(
        ["build", "--online", raw["online"], "--offline", raw["offline"], "--test", raw["offline_test"], "--star", f"{root}/star"]
    )
    return root


def test_built_star_gives_the_same_reports(spark, sf_dir, folders):
    star = writers.load_star(spark, f"{folders}/star")
    events = tpch.events(spark, sf_dir)
    assert star.transactions.count() == events.count()
    for report in (
        lambda f: trend.monthly_growth(f, catalog.PARAMS),
        lambda f: merchant.overall_stats(f, catalog.PARAMS),
        lambda f: merchant.merchant_usage(star.merchants, f, 50, catalog.PARAMS),
    ):
        assert report(star.transactions).collect() == report(events).collect()


def test_load_report_export(spark, folders):
    jobs.main(["load", "--star", f"{folders}/star"], catalog.PARAMS)
    star = writers.load_star(spark, f"{folders}/star")
    for name, df in star.tables().items():
        assert spark.table(name).count() == df.count()
    jobs.main(["report", "--star", f"{folders}/star", "--out", f"{folders}/reports"], catalog.PARAMS)
    for name in jobs.all_reports(star, catalog.PARAMS):
        written = glob.glob(f"{folders}/reports/{name}/part-*.csv")
        assert written and (name in jobs.LARGE or len(written) == 1), name
    jobs.main(["export", "--star", f"{folders}/star", "--out", f"{folders}/export"], catalog.PARAMS)
    assert len(glob.glob(f"{folders}/export/chart_*")) == 7
