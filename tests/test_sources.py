import glob

from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.plans import rfm, summary
from couponmill.schema import COUPONS, RFM_RESULT, TRANSACTIONS
from couponmill.sources import readers, tpch, writers


def parts(path):
    return sorted(glob.glob(f"{path}/part-*.csv"))


def test_csv_sink_marks_utf8_and_appends(spark, tmp_path):
    df = spark.createDataFrame([("满减券", 1), (None, 2)], "label string, n int")
    path = str(tmp_path / "out")
    writers.write_csv(df, path, single_file=True)
    (first,) = parts(path)
    data = open(first, "rb").read()
    assert data.startswith(b"\xef\xbb\xbflabel,n\n") and "满减券,1" in data.decode("utf-8")
    writers.write_csv(df, path, mode="append", single_file=True)
    assert len(parts(path)) == 2
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.IntegerType())])
    back = readers.load_table(spark, path, schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("满减券", 1), (None, 2)] * 2, key=str)


def test_bulk_load_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        '﻿Coupon_id,extra,discount_man,discount_rate\n"c,1",x,150,"150:20"\n"c""2",y,,\nc3,z,bad,0.9\n', encoding="utf-8"
    )
    rows = readers.load_table(spark, str(tmp_path / "t.csv"), COUPONS).orderBy("discount_rate").collect()
    assert [(r.coupon_id, r.discount_rate, r.discount_man and str(r.discount_man), r.discount_type) for r in rows] == [
        ('c"2', None, None, None), ("c3", "0.9", None, None), ("c,1", "150:20", "150.00", None)
    ]


def test_fact_survives_csv(spark, sf_dir, tmp_path):
    fact = tpch.transactions(spark, sf_dir)
    writers.write_csv(fact, str(tmp_path / "fact"))
    back = readers.load_table(spark, str(tmp_path / "fact"), TRANSACTIONS)
    assert back.count() == fact.count()
    assert back.exceptAll(fact).count() == 0


def test_rfm_result_as_tsv(spark, sf_dir, tmp_path):
    from couponmill.plans.catalog import PARAMS
    from couponmill.plans.export import export_rfm

    users = rfm.rfm_users(tpch.events(spark, sf_dir), PARAMS)
    writers.write_csv(users, str(tmp_path / "rfm"), bom=False, sep="\t")
    back = readers.read_tsv(spark, str(tmp_path / "rfm"), RFM_RESULT)
    assert export_rfm(back).collect() == export_rfm(users).collect()


def test_tables_and_summaries(spark, sf_dir):
    from couponmill.plans.catalog import PARAMS

    f = tpch.transactions(spark, sf_dir)
    assert writers.replace_table(f, "transactions") == f.count()
    assert writers.replace_table(f.limit(10), "few") == 10
    assert writers.replace_table(f.limit(5), "few", mode="append") == 5 and spark.table("few").count() == 15
    assert writers.replace_table(f.limit(3), "few") == 3 and spark.table("few").count() == 3
    stored = spark.table("transactions")
    rows = summary.build_summaries(stored, PARAMS)
    assert set(rows) == set(summary.SUMMARIES)
    for name, fn in summary.SUMMARIES.items():
        assert rows[name] == spark.table(name).count() == fn(stored, PARAMS).count()
    names = {r.tableName for r in writers.describe_tables(spark, "summary_*").collect()}
    assert names == set(summary.SUMMARIES)
    columns = {r.col_name for r in writers.describe_table(spark, "summary_gap_analysis").collect()}
    assert columns == {"gap_bucket", "cnt"}
    again = summary.materialize_summary(stored, "summary_gap_analysis", PARAMS)
    assert again.agg(F.sum("cnt")).first()[0] == stored.where("date_received IS NOT NULL AND source <> 'offline_test'").count()
    assert writers.sample_rows(stored).count() == 10
    counts = {r.table_name: r.row_count for r in writers.table_counts({"t": stored, "s": again}).collect()}
    assert counts == {"t": stored.count(), "s": again.count()}


def test_prepared_summary_is_preferred(spark):
    def compute():
        return spark.createDataFrame([("computed",)], "v string")

    assert readers.summary_or_compute(spark, "no_such_summary", compute).first().v == "computed"
    writers.materialize(spark.createDataFrame([("stored",)], "v string"), "prepared")
    assert readers.summary_or_compute(spark, "prepared", compute).first().v == "stored"


def test_summary_of_other_parameters_is_not_used(spark, sf_dir):
    from dataclasses import replace

    from couponmill.plans.catalog import PARAMS

    f = tpch.events(spark, sf_dir)
    other = replace(PARAMS, summary_min_received=PARAMS.summary_min_received + 1)
    summary.materialize_summary(f, "summary_gap_analysis", PARAMS)
    stored, computed = spark.table("summary_gap_analysis"), spark.range(1)

    def found(p):
        return readers.summary_or_compute(spark, "summary_gap_analysis", lambda: computed, summary.parameter_mark(p))

    assert found(PARAMS).columns == stored.columns
    assert found(replace(PARAMS)).columns == stored.columns
    assert found(other).columns == ["id"]
    # A table replaced without parameters is of unknown ones.
    writers.replace_table(spark.range(3), "summary_gap_analysis")
    assert readers.table_mark(spark, "summary_gap_analysis") is None and found(PARAMS).count() == 1


def test_shared_frames_are_computed_when_asked_for(spark, sf_dir, monkeypatch):
    from couponmill.plans.catalog import PARAMS

    made = []
    monkeypatch.setattr(summary, "merchant_counts", lambda f, p: made.append("counts") or f.limit(1))
    given = summary.shared(tpch.events(spark, sf_dir), PARAMS)
    assert set(given) == set(summary.SUMMARIES) and not made
    assert given["summary_merchant_usage"]() is given["summary_merchant_usage"]() and made == ["counts"]


def test_view_follows_the_fact_and_needs_no_scratch(spark, sf_dir):
    from couponmill.plans.catalog import PARAMS

    f = tpch.events(spark, sf_dir)
    rfm.register_rfm_view(f, "v_rfm_small", PARAMS)
    read = spark.table("v_rfm_small").inputFiles()
    assert read and all("v_rfm_small_rows" in path for path in read)
    users = spark.table("v_rfm_small").count()
    half = f.where("user_id % 2 = 0")
    rfm.register_rfm_view(half, "v_rfm_small", PARAMS)
    assert 0 < spark.table("v_rfm_small").count() == rfm.rfm_inputs(half, PARAMS).count() < users


def test_view_and_query(spark, sf_dir):
    from couponmill.plans.catalog import PARAMS

    rfm.register_rfm_view(tpch.events(spark, sf_dir), p=PARAMS)
    readers.register_tables({"coupon_events": tpch.events(spark, sf_dir)})
    out = readers.run_query(
        spark, "segments", "SELECT user_segment, count(*) AS n FROM v_user_rfm WHERE r_score >= :least GROUP BY 1", {"least": 4}
    )
    users = rfm.rfm_view(tpch.events(spark, sf_dir), PARAMS)
    assert sum(r.n for r in out.collect()) == users.where("r_score >= 4").count()
    assert readers.run_query(spark, "rows", "SELECT count(*) AS n FROM coupon_events").first().n > 0


def test_query_errors_are_raised(spark):
    import pytest

    with pytest.raises(Exception, match="no_such_table"):
        readers.run_query(spark, "broken", "SELECT * FROM no_such_table")
