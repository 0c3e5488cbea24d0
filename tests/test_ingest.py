"""Raw logs through cleaning to the star schema."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from couponmill.operators import ingest, star
from couponmill.schema import TRANSACTIONS
from couponmill.session import stage
from couponmill.sources import readers, writers

ONLINE = """User_id,Merchant_id,Action,Coupon_id,Discount_rate,Date_received,Date
11,21,2,null,null,null,20160105
11,22,1,c1,150:20,20160101,null
12,21,0,c2,fixed,20160102,null
12,21,2,c2,30:5,20160103,20160104
"""
OFFLINE = """User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date
13,21,c1,0.9,0,20160110,20160111
13,23,c3,null,null,20160112,null
14,23,,,5,bad,20160113
"""
TEST = """User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received
15,24,c4,20:1,x,20160701
"""


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in (("online", ONLINE), ("offline", OFFLINE), ("offline_test", TEST)):
        (folder / f"{name}.csv").write_text("﻿" + text if name == "offline" else text, encoding="utf-8")
    return [readers.read_raw(spark, str(folder / f"{n}.csv"), n) for n in ("online", "offline", "offline_test")]


@pytest.fixture(scope="module")
def tables(logs):
    return star.build_star(*logs)


def test_fact_rows(tables):
    rows = {r.transaction_id: r for r in tables.transactions.collect()}
    assert list(rows) and sorted(rows) == list(range(1, 9))
    assert [rows[i].source for i in range(1, 9)] == ["online"] * 4 + ["offline"] * 3 + ["offline_test"]
    first = rows[1]
    assert (first.coupon_id, first.discount_type, first.date_received, first.date_used) == (
        None, "none", None, date(2016, 1, 5)
    )
    assert (first.action, first.action_name, first.distance) == (2, "use", None)
    assert (rows[2].discount_man, rows[2].discount_jian, rows[2].discount_eq_rate) == (
        Decimal("150.00"), Decimal("20.00"), Decimal("0.8667")
    )
    assert rows[3].discount_type == "unknown"
    assert (rows[5].discount_type, rows[5].discount_eq_rate, rows[5].distance) == ("discount", Decimal("0.9000"), 0)
    assert (rows[5].action, rows[5].action_name) == (None, None)
    assert (rows[7].coupon_id, rows[7].date_received, rows[7].distance) == (None, None, 5)
    assert (rows[8].date_used, rows[8].distance) == (None, None)


def test_fact_schema(tables):
    assert [(f.name, f.dataType) for f in tables.transactions.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]


def test_dimensions(tables):
    assert sorted(r.user_id for r in tables.users.collect()) == [11, 12, 13, 14, 15]
    assert sorted(r.merchant_id for r in tables.merchants.collect()) == [21, 22, 23, 24]
    coupons = {r.coupon_id: r for r in tables.coupons.collect()}
    # The first rate seen wins: c1 online before offline, c2 its unusable text before 30:5.
    assert {k: r.discount_rate for k, r in coupons.items()} == {"c1": "150:20", "c2": "fixed", "c3": None, "c4": "20:1"}
    assert coupons["c1"].eq_discount == Decimal("0.8667") and coupons["c3"].discount_type == "none"


def test_bad_number_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(OFFLINE + "x,1,c,1,1,20160101,20160101\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_raw(spark, str(tmp_path / "bad.csv"), "offline", position=False).collect()


def test_ids_follow_input_order_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "offline"
    folder.mkdir()
    expected = []
    rnd = random.Random(3)
    for part in range(4):
        users = [rnd.randrange(10**6) for _ in range(400 + part)]
        expected += users
        lines = ["User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date"]
        lines += [f"{u},1,null,null,null,null,20160101" for u in users]
        (folder / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    for name, text in (("online", ONLINE), ("offline_test", TEST)):
        (tmp_path / f"{name}.csv").write_text(text)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        logs = [readers.read_raw(spark, str(tmp_path / p), k) for p, k in (
            ("online.csv", "online"), ("offline", "offline"), ("offline_test.csv", "offline_test"))]
        assert logs[1].select("_block").distinct().count() > 1
        fact = ingest.build_fact(*logs)
        got = [r.user_id for r in fact.orderBy("transaction_id").collect()]
        ids = [r.transaction_id for r in fact.orderBy("transaction_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert ids == list(range(1, len(expected) + 6))
    assert got == [11, 11, 12, 12] + expected + [15]


def test_first_by_keeps_one_row_per_key(spark):
    df = spark.range(3000).select(
        (F.col("id") % 7).alias("k"), (3000 - F.col("id")).alias("pos"), F.col("id").cast("string").alias("v")
    ).repartition(5)
    got = {r.k: r.v for r in star.first_by(df, "k", "v", ["pos"]).collect()}
    assert got == {k: str(max(i for i in range(3000) if i % 7 == k)) for k in range(7)}


def test_star_round_trip(spark, tables, tmp_path):
    writers.save_star(tables, str(tmp_path))
    stored = writers.load_star(spark, str(tmp_path))
    assert {n: df.count() for n, df in stored.tables().items()} == {
        "users": 5, "merchants": 4, "coupons": 4, "transactions": 8
    }
    assert [r.user_id for r in stored.users.collect()] == [11, 12, 13, 14, 15]
    offline = stored.transactions.where("source = 'offline'")
    plan = offline._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and offline.count() == 3
    pruned = readers.read_fact(spark, f"{tmp_path}/transactions", ["user_id", "date_used"])
    assert pruned.columns == ["user_id", "date_used"]


def test_align_project_canonical(spark):
    df = spark.createDataFrame([(1, "20160101")], "User_id long, Date string")
    out = ingest.align(ingest.clean_log(df, "offline"))
    assert out.first().date_used == date(2016, 1, 1) and out.first().merchant_id is None
    assert ingest.project(out, ["source", "nope", "user_id"]).columns == ["source", "user_id"]


def test_stored_fact_is_in_day_order_and_typed(spark, tables, tmp_path):
    writers.save_star(tables, str(tmp_path))
    stored = writers.load_star(spark, str(tmp_path))
    assert [f.name for f in stored.transactions.schema] == [f.name for f in TRANSACTIONS]
    assert dict(stored.transactions.dtypes) == {f.name: f.dataType.simpleString() for f in TRANSACTIONS}
    for path in stored.transactions.inputFiles():
        days = [r.date_used for r in spark.read.parquet(path).select("date_used").collect()]
        known = [d for d in days if d]
        assert days == [None] * (len(days) - len(known)) + sorted(known)
    used = stored.transactions.where("date_used >= '2016-02-01'")
    assert "GreaterThanOrEqual(date_used,2016-02-01)" in used._jdf.queryExecution().executedPlan().toString()


def test_broken_lines_and_lost_values_are_counted(spark, tmp_path):
    from couponmill.operators import rejects

    (tmp_path / "offline.csv").write_text(
        "User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date\n"
        "1,2,c1,0.8,3,20000101,20000102\n"
        "x,2,c1,0.8,3,20000101,20000102\n"
        "1,2,c1\n"
        "1,2,c1,0.8,far,20001301,null\n"
        "3,2,null,15000,null,null,later\n"
        "3,2,null,null,NA,20000105,null\n"
    )
    log = readers.read_raw(spark, str(tmp_path / "offline.csv"), "offline", keep_broken=True)
    written = []
    fact, lost = rejects.build_fact_counted({"offline": log}, put=lambda df: written.append(df) or stage(df))
    got = {(r.source, r.field): r.row_count for r in lost.collect()}
    assert got == {
        ("offline", "lines"): 6, ("offline", "broken_lines"): 2, ("offline", "date_received"): 1, ("offline", "date_used"): 1,
        ("offline", "distance"): 1, ("discounts", "threshold"): 0, ("discounts", "reduction"): 0, ("discounts", "rate"): 1,
    }
    assert len(written) == 2
    assert sorted(r.transaction_id for r in fact.collect()) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_raw(spark, str(tmp_path / "offline.csv"), "offline").collect()
