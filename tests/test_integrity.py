import pytest
from pyspark.sql import functions as F

from couponmill.functions.cleaning import with_discount
from couponmill.operators import integrity as g
from couponmill.operators.keyed import hot_keys, keyed_join


@pytest.fixture(scope="module")
def fact(spark):
    """Key 1 holds half of the rows; key 9 is unknown; some rows have no key."""
    rows = [(i, 1 if i % 2 else (None if i % 10 == 0 else i % 8)) for i in range(400)] + [(1000, 9), (1001, 9)]
    return spark.createDataFrame(rows, "id long, k long").repartition(5).cache()


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(1,), (2,), (4,), (77,)], "k long")


def test_orphans(fact, dim):
    got = {r.k: r.row_count for r in g.orphans(fact, dim, "k").collect()}
    data = fact.toPandas()["k"].dropna()
    want = data[~data.isin([1, 2, 4, 77])].value_counts().to_dict()
    assert got == want and 9 in got


def test_orphan_report(fact, dim):
    row = g.orphan_report(fact, {"keys": (dim, "k")}).first()
    data = fact.toPandas()["k"].dropna()
    missing = data[~data.isin([1, 2, 4, 77])]
    assert (row.key_count, row.missing_keys, row.orphan_rows) == (data.nunique(), missing.nunique(), len(missing))


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("how", ["left_semi", "left_anti", "left"])
def test_keyed_join_broadcast_and_salted(fact, dim, how, limit):
    doubled = dim.union(dim)
    got = keyed_join(fact, doubled, "k", how, limit)
    if how == "left":
        want = fact.withColumn("_known", F.when(F.col("k").isin(1, 2, 4, 77), True))
    else:
        known = F.coalesce(F.col("k").isin(1, 2, 4, 77), F.lit(False))
        want = fact.where(known if how == "left_semi" else ~known)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got.columns == want.columns


def test_salt_spreads_hot_and_missing_keys(spark, fact, dim):
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyed_join(fact, dim, "k", "left", 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert "_salt" in plan and "BroadcastHashJoin" not in plan


def test_cascade_and_set_null(fact, dim):
    kept = g.cascade(fact, dim, "k")
    assert {r.k for r in kept.select("k").distinct().collect()} <= {1, 2, 4, 77}
    cleared = g.set_null_missing(fact, dim, "k")
    assert cleared.count() == fact.count() and cleared.columns == fact.columns
    assert cleared.where("k IS NOT NULL").count() == kept.count()


def test_duplicates_and_invalid_values(spark):
    df = spark.createDataFrame([(1, "fixed"), (1, "odd"), (2, None)], "k int, discount_type string")
    assert [tuple(r) for r in g.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in g.invalid_values(df).collect()] == [("odd", 1)]


def test_hot_keys_are_those_above_an_even_share(spark, fact, dim):
    assert hot_keys(fact, "k", 8) == [1]
    assert hot_keys(fact.where("k IS NULL"), "k", 8) == []


def test_hot_key_is_spread_over_many_tasks(spark):
    """A third of the rows holds one key, all rows of it being copies."""
    rows = spark.range(3000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    f = rows.withColumn("v", F.when(F.col("k") > 0, F.rand(5)).otherwise(0.0))
    known = spark.range(3000).withColumnRenamed("id", "k")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = keyed_join(f, known, "k", "left_semi", 0)
        sizes = [r[0] for r in joined.where("k = 0").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 1000 and max(sizes) <= 600


def test_overflowing_discounts_are_counted(spark):
    texts = ["15000", "0.01:200", "99999999999:1", "5:99999999999", "-5:1", "0:5", "0.8", "100:10", "x", "", None]
    df = with_discount(spark.createDataFrame([(t,) for t in texts], "discount_rate string"))
    got = {r.field: r.row_count for r in g.discount_overflow(df).collect()}
    assert got == {"rate": 3, "threshold": 1, "reduction": 1}
    assert g.discount_overflow(df.limit(0)).count() == 0


def test_amounts_too_small_for_their_decimals_are_counted(spark):
    texts = ["0.00004", "0.00006", "0.004:0.001", "0.005:1", "100:0.001", "100:0", "0:0", "100000:99999", "0.8"]
    df = with_discount(spark.createDataFrame([(t,) for t in texts], "discount_rate string"))
    got = {r.field: r.row_count for r in g.discount_overflow(df).collect()}
    # 0.005:1 has a threshold of 0.01 but a rate below the declared decimals.
    assert got == {"rate": 2, "threshold": 1, "reduction": 2}


def test_ties_of_the_equivalent_rate_are_exact(spark):
    """153 / 160 is 0.95625 exactly and 151 / 160 is 0.94375: half to even."""
    df = with_discount(spark.createDataFrame([("160:7",), ("160:9",)], "discount_rate string"))
    assert [str(r.discount_eq_rate) for r in df.orderBy("discount_rate").collect()] == ["0.9562", "0.9438"]
