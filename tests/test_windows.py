import pandas as pd

from couponmill.operators import windows as w


def frame(spark):
    rows = [("a", 1, 10), ("a", 2, 15), ("a", 3, 0), ("a", 4, 5), ("b", 1, 7)]
    return spark.createDataFrame(rows, "k string, t int, n long")


def test_growth_per_group(spark):
    got = w.growth(frame(spark), "n", "t", ["k"], change="d", following="nx").orderBy("k", "t").collect()
    assert [(r.previous, r.nx, r.d, r.growth_pct) for r in got] == [
        (None, 15, None, None), (10, 0, 5, 50.0), (15, 5, -15, -100.0), (0, None, 5, None), (None, None, None, None)
    ]


def test_growth_rounds_away_from_zero(spark):
    df = spark.createDataFrame([(1, 800), (2, 799)], "t int, n long")
    assert w.growth(df, "n", "t").orderBy("t").collect()[1].growth_pct == -0.13


def test_running_sum_and_rank(spark):
    out = w.rank_within(w.running_sum(frame(spark), "n", "t", "total", ["k"]), "-n", ["k"], "rk")
    assert [(r.total, r.rk) for r in out.orderBy("k", "t").collect()] == [(10, 2), (25, 1), (25, 4), (30, 3), (7, 1)]


def test_moving_avg_matches_pandas(spark):
    data = pd.DataFrame({"t": range(60), "n": [(i * 37) % 101 for i in range(60)]})
    got = w.moving_avg(spark.createDataFrame(data), "n", "t", 7, "ma", 4).orderBy("t").toPandas()
    want = data["n"].rolling(7, min_periods=1).mean().round(4)
    assert (got["ma"] - want).abs().max() < 1e-9


def test_period_ends(spark):
    row = w.period_ends(frame(spark), "n", "k", "t").orderBy("k").first()
    assert (row.first_day_count, row.last_day_count, row.peak_day_count, row.avg_daily_count) == (10, 5, 15, 7.5)


def test_share_sums_to_hundred(spark):
    rows = w.share(frame(spark), "n").collect()
    assert abs(sum(r.pct for r in rows) - 100) < 0.05
    empty = w.share(frame(spark).where("n < 0"), "n")
    assert empty.collect() == []


def test_above_mean(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0)], "k string, r double")
    rows = w.above_mean(df, "r").orderBy("k").collect()
    assert [r.above_mean for r in rows] == [False, True, True] and float(rows[0].mean_rate) == 20.0
