from dataclasses import replace
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from couponmill.functions import derive
from couponmill.functions.measures import cond_count, mean_of, pct, ratio, uniques
from couponmill.params import CHART_TYPE_LABELS, DISTANCE, EXPORT_DISTANCE, EXPORT_THRESHOLD, GAP, THRESHOLD


def labels(spark, values, spec, kind="int"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.b for r in df.select("i", derive.bucket("v", spec).alias("b")).orderBy("i").collect()]


def test_gap_buckets(spark):
    values = [None, -40, -1, 0, 1, 2, 3, 4, 7, 8, 15, 16, 30, 31, 400]
    assert labels(spark, values, GAP) == [
        "未核销", "2-3天", "2-3天", "当天核销", "次日核销", "2-3天", "2-3天", "4-7天", "4-7天", "8-15天", "8-15天",
        "16-30天", "16-30天", ">30天", ">30天",
    ]


def test_negative_gap_label_is_optional(spark):
    assert labels(spark, [-1, 0], replace(GAP, negative="早于领取")) == ["早于领取", "当天核销"]


def test_labels_may_hold_quotes(spark):
    assert labels(spark, [-1], replace(GAP, negative="user's \\ 'early'")) == ["user's \\ 'early'"]


def test_distance_buckets(spark):
    values = [None, 0, 1, 2, 3, 4, 5, 6, 10, 11]
    assert labels(spark, values, DISTANCE) == [
        "未知", "0m（同位置）", "1m", "2-3m", "2-3m", "4-5m", "4-5m", "6-10m", "6-10m", ">10m"
    ]
    assert labels(spark, [0, 11], EXPORT_DISTANCE) == ["0m(同位置)", "10m+"]


def test_threshold_buckets(spark):
    values = [None, 0.0, 20.0, 20.01, 50.0, 100.0, 200.0, 500.0, 500.01]
    assert labels(spark, values, THRESHOLD, "double") == [
        "非满减", "≤20元", "≤20元", "21-50元", "21-50元", "51-100元", "101-200元", "201-500元", ">500元"
    ]
    assert labels(spark, [5.0], EXPORT_THRESHOLD, "double") == ["<=20元"]


def test_every_label_is_ordered():
    for spec in (GAP, DISTANCE, EXPORT_DISTANCE, THRESHOLD, EXPORT_THRESHOLD):
        names = {spec.missing, spec.above, *[n for _, n in spec.exact + spec.upper]}
        assert names == set(spec.order)


def test_calendar_parts(spark):
    days = [date(2016, 1, 1), date(2016, 1, 2), date(2016, 1, 3), date(2016, 1, 4), date(2018, 12, 31), None]
    rows = (
        spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
        .select(
            "i",
            derive.day_type("d").alias("kind"),
            derive.ym("d").alias("ym"),
            derive.year_week("d").alias("yw"),
        )
        .orderBy("i")
        .collect()
    )
    assert [r.kind for r in rows] == ["工作日", "周末", "周末", "工作日", "工作日", "未知"]
    assert [r.ym for r in rows] == ["2016-01"] * 4 + ["2018-12", None]
    assert [r.yw for r in rows] == [201553, 201553, 201553, 201601, 201901, None]
    for d, r in zip(days[:-1], rows):
        iso = pd.Timestamp(d).isocalendar()
        assert r.yw == iso.year * 100 + iso.week


def test_recency_and_gap(spark):
    df = spark.createDataFrame(
        [(date(2016, 7, 1), date(2016, 7, 4)), (None, date(2016, 7, 4))], "date_used date, date_received date"
    )
    rows = df.select(
        derive.recency("date_used", date(2016, 7, 31), date(2016, 1, 1)).alias("r"), derive.gap_days().alias("g")
    ).collect()
    assert [tuple(r) for r in rows] == [(30, -3), (212, None)]


def test_type_labels(spark):
    df = spark.createDataFrame([("fixed",), ("discount",), ("none",), ("unknown",), ("odd",), (None,)], "t string")
    rows = df.select(
        derive.type_label("t").alias("a"), derive.type_label("t", CHART_TYPE_LABELS, default="t").alias("b")
    ).collect()
    assert [r.a for r in rows] == ["满减券", "折扣券", "无优惠券", "未知", "未知", "未知"]
    assert [r.b for r in rows] == ["满减券", "折扣券", "无优惠券", "未知类型", "odd", None]


def test_rfm_segments_cover_every_score(spark):
    grid = spark.range(25).select(
        (F.floor(F.col("id") / 5) + 1).cast("int").alias("r_score"), (F.col("id") % 5 + 1).cast("int").alias("f_score")
    )
    rows = grid.withColumn("m_score", F.lit(3)).withColumns(derive.rfm_combine()).select(
        "*", derive.rfm_segment().alias("s"), derive.rfm_sub_segment().alias("sub")
    )
    got = {(r.r_score, r.f_score): r for r in rows.collect()}
    segments = ["流流般沉沉", "流流般沉沉", "般般活活活", "新新活核核", "新新活核核"]
    names = {"流": "流失用户", "般": "一般用户", "沉": "沉睡用户", "活": "活跃用户", "新": "新用户", "核": "核心用户"}
    for r, line in enumerate(segments, 1):
        for f, mark in enumerate(line, 1):
            assert got[(r, f)].s == names[mark], (r, f)
    assert got[(5, 5)].sub == "超级核心" and got[(4, 5)].sub == "核心" and got[(5, 3)].sub == "潜力"
    assert got[(1, 1)].sub == "待激活" and got[(2, 2)].sub == "流失边缘" and got[(3, 3)].sub == "稳定"
    assert got[(1, 4)].sub == "沉睡-高价值" and got[(4, 1)].sub == "新客"
    assert got[(5, 4)].rfm_total == 12 and got[(5, 4)].rfm_cell == "543" and got[(5, 4)].rfm_weighted == 4.2


def test_ratios(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (1, 800), (0, 5), (7, 5), (None, 5)], "a long, b long")
    rows = df.select(
        pct("a", "b").alias("p"), pct("a", "b", half_even=True).alias("e"), ratio("a", "b", 1).alias("q")
    ).collect()
    assert [r.p for r in rows] == [33.33, None, 0.13, 0.0, 140.0, None]
    assert [r.e for r in rows] == [33.33, None, 0.12, 0.0, 140.0, None]
    assert [r.q for r in rows] == [0.3, None, 0.0, 0.0, 1.4, None]


def test_aggregate_expressions(spark):
    df = spark.createDataFrame(
        [(1, "0.1000", True), (1, "0.1001", True), (2, None, False), (None, "0.9000", False)],
        "k int, rate string, use boolean",
    ).withColumn("rate", F.col("rate").cast("decimal(6,4)"))
    users, rates = uniques("k", "rate")
    row = df.agg(
        mean_of("rate", 4).alias("m"),
        mean_of("rate", 4, F.col("use")).alias("mc"),
        mean_of("rate", 4, F.col("k") == 9).alias("none"),
        cond_count(F.col("use")).alias("n"),
        users.alias("u"),
        rates.alias("r"),
    ).first()
    assert (float(row.m), float(row.mc), row.none, row.n, row.u, row.r) == (0.3667, 0.1001, None, 2, 2, 3)


def test_published_rates(spark):
    """Percentages and ratios published for known counts."""
    rates = [
        (3853, 35838, 10.75), (131546, 131546, 100.0), (156442, 1871895, 8.36), (46852, 348179, 13.46),
        (8602, 143871, 5.98), (5346, 136223, 3.92), (2118, 71552, 2.96), (4247, 247454, 1.72), (8217, 106003, 7.75),
        (48824, 361375, 13.51), (57939, 686285, 8.44), (18723, 344949, 5.43), (19017, 322338, 5.9),
        (9605, 133328, 7.2), (2334, 23620, 9.88), (135399, 167384, 80.89),
        (198656, 2039279, 9.74), (16833, 2039279, 0.83), (18509, 2039279, 0.91), (23864, 2039279, 1.17),
        (19509, 2039279, 0.96), (11937, 2039279, 0.59), (2533, 2039279, 0.12), (1747438, 2039279, 85.69),
        (130317, 845738, 15.41), (66693, 845738, 7.89), (198769, 845738, 23.5), (76586, 845738, 9.06),
        (171876, 845738, 20.32), (201497, 845738, 23.82),
    ]
    df = spark.createDataFrame(rates, "a long, b long, want double")
    for row in df.select("*", pct("a", "b", half_even=True).alias("got"), pct("a", "b").alias("sql")).collect():
        assert row.got == row.want == row.sql
    uses = [
        (1940071, 381502, 5.09), (1116562, 280400, 3.98), (2093507, 424942, 4.93),
        (1952447, 408455, 4.78), (2131073, 447768, 4.76), (2317252, 434542, 5.33),
    ]
    df = spark.createDataFrame(uses, "a long, b long, want double")
    assert all(r.got == r.want for r in df.select("*", ratio("a", "b", half_even=True).alias("got")).collect())
