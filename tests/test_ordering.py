import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from couponmill.operators import ordering as o


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value; some values are NULL."""
    rnd = random.Random(7)
    rows = []
    for i in range(3001):
        value = 5 if rnd.random() < 0.34 else rnd.choice([None, *range(40)])
        rows.append((i * 7919 % 3001, value, rnd.randrange(1000)))
    return spark.createDataFrame(rows, "id long, v int, w int").repartition(6).cache()


def test_row_id_equals_window(skewed):
    want = skewed.select("id", F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "id")).alias("n"))
    got = o.with_row_id(skewed, ["-v", "id"], "n").select("id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_value_is_split(skewed):
    keys = o.sort_columns(["v", "id"])
    sizes = [
        r["count"]
        for r in skewed.repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).count().collect()
    ]
    assert len(sizes) == 8 and max(sizes) < 0.25 * 3001


def test_ntile_equals_window(skewed):
    for k in (1, 3, 5, 10):
        want = skewed.select("id", F.ntile(k).over(Window.orderBy(F.col("v").asc_nulls_first(), "id")).alias("t"))
        got = o.ntile_all(skewed, k, "v", ["id"], "t").select("id", "t")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), k


def test_ntile_of_few_rows(spark):
    for n in (0, 1, 3, 4, 6):
        df = spark.range(n).withColumn("v", F.lit(1))
        got = [r.t for r in o.ntile_all(df, 5, "v", ["id"], "t").orderBy("id").collect()]
        want = [r.t for r in df.select("id", F.ntile(5).over(Window.orderBy("v", "id")).alias("t")).orderBy("id").collect()]
        assert got == want, n


@given(st.integers(0, 400), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_ntile_cut_positions(rows, tiles):
    cuts = o.ntile_cuts(rows, tiles)
    sizes = [len(part) for part in np.array_split(np.arange(rows), tiles)]
    tile_of = np.repeat(np.arange(1, tiles + 1), sizes)
    assert [1 + sum(i > c for c in cuts) for i in range(rows)] == tile_of.tolist()


def test_several_metrics_share_one_pass(skewed):
    df = skewed.where("v IS NOT NULL")
    columns = o.ntile_columns(df, 5, ["v", "w"], ["id"])
    got = df.select("id", columns["v"].alias("a"), columns["w"].alias("b"))
    want = df.select(
        "id",
        F.ntile(5).over(Window.orderBy("v", "id")).alias("a"),
        F.ntile(5).over(Window.orderBy("w", "id")).alias("b"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quantile_edges_match_numpy(skewed):
    df = skewed.where("v IS NOT NULL")
    edges = o.quantile_edges(df, ["v", "w"], ["id"], 5)
    data = df.toPandas()
    for c in ("v", "w"):
        assert np.allclose(edges[c], np.quantile(data[c], [0, 0.2, 0.4, 0.6, 0.8, 1]), rtol=0, atol=1e-9)


def test_quantile_bins_match_pandas(skewed):
    df = skewed.where("v IS NOT NULL")
    got = {r.id: r.b for r in o.qcut(df, "w", ["id"], 5, "b").collect()}
    data = df.toPandas()
    want = pd.qcut(data["w"], 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got == dict(zip(data["id"], want))


def test_repeated_edges_fall_back(spark):
    df = spark.range(50).withColumn("v", F.when(F.col("id") < 40, 1).otherwise(F.col("id")))
    assert {r.b for r in o.qcut(df, "v", ["id"], 5, "b").collect()} == {3}
    with pytest.raises(ValueError):
        pd.qcut(df.toPandas()["v"], 5, labels=[1, 2, 3, 4, 5], duplicates="drop")
    assert o.qcut(df.limit(0), "v", ["id"], 5, "b").collect() == []


def test_rank_all_equals_windows(skewed):
    by = Window.orderBy(F.col("v").desc_nulls_last())
    want = skewed.select(
        "id",
        F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "id")).alias("row_num"),
        F.rank().over(by).alias("rank_num"),
        F.dense_rank().over(by).alias("dense_rnk"),
        F.round(F.percent_rank().over(by) * 100, 2).alias("pct_rank"),
    )
    got = o.rank_all(skewed, "-v", ["id"]).select("id", "row_num", "rank_num", "dense_rnk", "pct_rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert all(r.rank_num >= r.dense_rnk for r in got.collect())


@pytest.mark.parametrize("k", [1, 20, 5000])
def test_rank_top_equals_full_windows(skewed, k):
    df = skewed.where("v IS NOT NULL")
    by, every = Window.orderBy(F.desc("v")), Window.orderBy(F.desc("v"), "id")
    want = (
        df.select(
            "id",
            F.row_number().over(every).alias("row_num"),
            F.rank().over(by).alias("rank_num"),
            F.dense_rank().over(by).alias("dense_rnk"),
            F.round(F.percent_rank().over(by) * 100, 2).alias("pct_rank"),
            F.ntile(10).over(every).alias("decile"),
        )
        .orderBy("row_num")
        .limit(k)
    )
    got = o.rank_top(df, "-v", ["id"], k, total=df.count()).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rank_top_of_few_rows(spark):
    df = spark.range(3).withColumn("v", F.col("id"))
    rows = o.rank_top(df, "-v", ["id"], 50, total=3).orderBy("row_num").collect()
    assert [(r.id, r.pct_rank, r.decile) for r in rows] == [(2, 0.0, 1), (1, 50.0, 2), (0, 100.0, 3)]
    one = o.rank_top(df.where("id = 1"), "-v", ["id"], 50, total=1).first()
    assert (one.pct_rank, one.decile) == (0.0, 1)


def test_label_order_and_top(spark):
    df = spark.createDataFrame([("b", 1), ("z", 2), ("a", 3), ("c", 3)], "k string, n int")
    assert [r.k for r in o.order_labels(df, "k", ("c", "b", "a")).collect()] == ["c", "b", "a", "z"]
    assert [r.k for r in o.top_k(df, ["-n", "k"], 2).collect()] == ["a", "c"]
    assert "TakeOrdered" in o.top_k(df, ["-n", "k"], 2)._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_when_counted_small(spark):
    small, big = spark.range(10), spark.range(5000)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(o.sized_broadcast(small, 10), "id")._jdf.queryExecution().executedPlan().toString()
        plain = big.join(o.sized_broadcast(small, 9), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert "BroadcastHashJoin" in hinted and "BroadcastHashJoin" not in plain


def test_copies_of_one_row_are_spread(spark):
    df = spark.range(8000).repartition(8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("v")
    )
    got = o.with_row_id(df, ["v"], "n").cache()
    assert sorted(r.n for r in got.collect()) == list(range(1, 8001))
    before = None
    for r in got.orderBy("n").collect():
        assert before is None or before <= r.v
        before = r.v
    tagged = df.withColumn("_from", F.spark_partition_id()).repartitionByRange(8, "v", "_from")
    sizes = [r["count"] for r in tagged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.25 * 8000


def test_inexact_metrics_are_refused(spark):
    df = spark.range(5).withColumn("v", F.rand(1))
    with pytest.raises(TypeError, match="v: double"):
        o.ntile_all(df, 5, "v", ["id"])


def test_positions_by_counts_equal_sorting(spark):
    """NULLs, heavy ties and positions at the ends of values, with and without sketches."""
    random = np.random.default_rng(6)
    v = [None if x < 0.05 else int(x * 10) for x in random.random(3000)]
    w = [round(float(x), 4) for x in random.standard_normal(3000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(v, w))], "id long, v int, w double")
    df = df.withColumn("w", F.col("w").cast("decimal(12,4)")).repartition(5)
    data = df.toPandas().sort_values("id")
    wanted = [0, 1, 149, 150, 700, 1499, 2998, 2999]
    for sketch in (False, True):
        stats = o.order_statistics(df, ["v", "w"], ["id"], lambda n: wanted, sketch)
        for m in ("v", "w"):
            order = sorted(range(3000), key=lambda i: (data[m].iloc[i] is not None and data[m].iloc[i] == data[m].iloc[i],
                                                       data[m].iloc[i] if data[m].iloc[i] == data[m].iloc[i] else 0, i))
            assert stats[m].rows == 3000 and sorted(stats[m].at) == wanted
            for position, found in stats[m].at.items():
                value, number = data[m].iloc[order[position]], order[position]
                assert (found[0] is None) == (value is None or value != value)
                assert found[0] is None or float(found[0]) == float(value)
                last = position == 2999 or data[m].iloc[order[position + 1]] != value
                assert found[1:] == (() if last and found[0] is not None else (number,)) or found[0] is None


def test_few_counts_are_shuffled(spark):
    """A metric of few values is as few counts; with brackets, so is one whose values all differ."""
    df = spark.range(20000).select("id", (F.col("id") % 3).alias("few"), (F.col("id") * 7919 % 20011).alias("many"))
    assert o._counted_values(df, ["few"], None).count() == 3
    brackets = o._brackets(df, ["many"], [4000, 4001, 12000], 20000)
    assert o._counted_values(df, ["many"], brackets).count() < 1000
    edges = o.quantile_edges(df, ["many", "few"], [], 5)
    data = df.toPandas()
    for m in ("many", "few"):
        assert np.allclose(edges[m], np.quantile(data[m], [0, 0.2, 0.4, 0.6, 0.8, 1]))


def test_sketch_edges_are_near(spark):
    df = spark.range(30000).select("id", F.pmod(F.xxhash64("id"), F.lit(100000)).alias("v"))
    for accuracy in (100, 2000):
        edges = o.sketch_edges(df, ["v"], [], 5, accuracy)["v"]
        assert 0 <= o.rank_error(df, "v", edges) <= 1 / accuracy
    assert o.rank_error(df, "v", [0, 0, 50000, 100000]) > 0.1
    assert o.sketch_edges(df.limit(0), ["v"], [], 5) == {"v": []} and o.rank_error(df.limit(0), "v", []) == 0.0
    bins = {r["b"] for r in o.qcut(df, "v", [], 5, "b", edges=o.sketch_edges).select("b").distinct().collect()}
    assert bins == {1, 2, 3, 4, 5}
