"""Live view, safe replacement, batches and mergeable states."""

import pytest
from pyspark.sql import functions as F

from couponmill.plans import catalog, export, incremental, liveview, rfm, summary
from couponmill.plans.catalog import PARAMS
from couponmill.session import delete_path, folders_in
from couponmill.sources import readers, tpch, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tied_fact(spark):
    """Most users use once on one day, so nearly all tile borders fall inside one value; ids of both signs and sizes."""
    ids = [*range(-40, 60), *(10**12 + i * 7919 for i in range(50)), *(-(2**62) + i for i in range(20)), 2**63 - 1]
    out = []
    for n, user in enumerate(ids):
        for k in range(1 if n % 9 else 3):
            out.append((user, f"2000-01-{1 + (k if n % 9 == 0 else 0):02d}", "online" if n % 2 else "offline", 10 if n % 4 else n))
    out += [(5, None, "online", 3), (77_777, None, "online", 3), (5, "2000-03-01", "offline_test", 9)]
    df = spark.createDataFrame(out, "user_id long, day string, source string, man int")
    return df.select(
        "user_id", F.to_date("day").alias("date_used"), F.to_date(F.lit("1999-12-01")).alias("date_received"), "source",
        F.col("man").cast("decimal(10,2)").alias("discount_man"),
    )


def test_live_view_equals_the_report_and_follows_appends(spark):
    f = tied_fact(spark)
    writers.replace_table(f.where("user_id >= 0"), "tied_fact")
    view = liveview.register_live_rfm_view(spark, "tied_fact", "v_tied", PARAMS)
    assert rows(view) == rows(rfm.rfm_view(f.where("user_id >= 0"), PARAMS))
    writers.replace_table(f.where("user_id < 0"), "tied_fact", mode="append")
    assert rows(spark.table("v_tied")) == rows(rfm.rfm_view(f, PARAMS))
    for few in (0, 1, 3, 7):
        some = f.where("user_id >= 0 AND source <> 'offline_test'").dropDuplicates(["user_id"]).orderBy("user_id").limit(few)
        writers.replace_table(some, "tied_fact")
        assert rows(spark.table("v_tied")) == rows(rfm.rfm_view(some, PARAMS))


def test_live_view_reads_the_fact_once_and_has_no_global_task(spark, sf_dir):
    writers.replace_table(tpch.events(spark, sf_dir), "live_fact")
    view = liveview.register_live_rfm_view(spark, "live_fact", "v_live", PARAMS)
    view.collect()
    text = view._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("Scan parquet") <= 1 and "ReusedExchange" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # The one single-partition exchange brings the border lists together, one row per metric.
    lines = text.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1 and "collect_list" in lines[single[0] + 1]


def test_failed_load_keeps_the_old_rows(spark):
    writers.replace_table(spark.range(5), "safe")
    broken = spark.range(5).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id") + 9))
    with pytest.raises(Exception, match="no"):
        writers.replace_table(broken, "safe")
    assert rows(spark.table("safe")) == [(i,) for i in range(5)]
    # A table can be replaced by a query on itself, and with other columns.
    assert writers.replace_table(spark.table("safe").where("id > 1"), "safe", mark="m") == 3
    assert rows(spark.table("safe")) == [(2,), (3,), (4,)] and readers.table_mark(spark, "safe") == "m"
    assert writers.replace_table(spark.table("safe").withColumn("n", F.lit(1)), "safe") == 3
    assert spark.table("safe").columns == ["id", "n"] and readers.table_mark(spark, "safe") is None
    writers.replace_table(spark.range(2).withColumn("n", F.lit(2)), "safe", mark="again")
    assert len(folders_in(spark, writers._versions(spark, "safe"))) == 2
    assert rows(spark.table("safe")) == [(0, 2), (1, 2)]


def test_tables_after_a_failed_one_stay(spark):
    writers.load_tables({"dim_a": spark.range(2), "fact_a": spark.range(3)})
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.load_tables({"dim_a": broken, "fact_a": spark.range(9)})
    assert spark.table("dim_a").count() == 2 and spark.table("fact_a").count() == 3


def test_summary_follows_the_files_of_the_fact(spark, sf_dir):
    events = tpch.events(spark, sf_dir)
    writers.replace_table(events.where("user_id % 2 = 0"), "marked_fact")
    fact = lambda: spark.table("marked_fact")
    mark = readers.data_mark(fact())
    stored = summary.materialize_summary(fact(), "summary_monthly_trend", PARAMS)
    assert readers.data_mark(fact()) == mark
    assert summary.current_summary(fact(), "summary_monthly_trend", PARAMS).inputFiles() == stored.inputFiles()
    writers.replace_table(events.where("user_id % 2 = 1"), "marked_fact", mode="append")
    assert readers.data_mark(fact()) != mark
    assert rows(summary.current_summary(fact(), "summary_monthly_trend", PARAMS)) == rows(summary.summary_monthly_trend(events, PARAMS))
    # By parameters alone the stored one still counts.
    compute = lambda: spark.range(1)
    assert readers.summary_or_compute(spark, "summary_monthly_trend", compute, summary.parameter_mark(PARAMS)).columns == stored.columns


def test_csv_batches_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "out")
    assert writers.append_csv_once(spark.range(3), path, "a") and not writers.append_csv_once(spark.range(3), path, "a")
    assert writers.append_csv_once(spark.range(2), path, "b")
    assert spark.read.option("header", True).csv(path).count() == 5
    with pytest.raises(ValueError, match="batch"):
        writers.append_csv_once(spark.range(2), path, "../b")


@pytest.fixture(scope="module")
def logs(spark, sf_dir, tmp_path_factory):
    paths = catalog.write_raw_logs(spark, sf_dir, str(tmp_path_factory.mktemp("raw")))
    return {source: readers.read_raw(spark, path, source) for source, path in paths.items()}


@pytest.fixture(scope="module")
def grown(spark, logs, tmp_path_factory):
    """Two batches, the first loaded twice and its state built before the second came."""
    folder = str(tmp_path_factory.mktemp("grown"))
    assert incremental.append_batch(spark, folder, "b1", {"online": logs["online"]})
    assert incremental.update_states(spark, folder, "monthly", PARAMS) == ["b1"]
    assert not incremental.append_batch(spark, folder, "b1", {"online": logs["online"]})
    assert incremental.append_batch(spark, folder, "b2", {k: v for k, v in logs.items() if k != "online"})
    return folder


def test_ids_go_on_from_the_stored_end(spark, sf_dir, logs, grown):
    entries = {r["batch"]: (r["first_id"], r["row_count"]) for r in incremental.ledger(spark, grown).collect()}
    first = logs["online"].count()
    total = tpch.events(spark, sf_dir).count()
    assert entries == {"b1": (1, first), "b2": (first + 1, total - first)}
    ids = incremental.facts(spark, grown).agg(F.min("transaction_id"), F.max("transaction_id"), F.count_distinct("transaction_id"))
    assert tuple(ids.first()) == (1, total, total)


def test_only_the_files_of_new_batches_are_read(spark, sf_dir, grown, monkeypatch):
    read, facts = [], incremental.facts

    def recorded(spark, folder, batches=None):
        df = facts(spark, folder, batches)
        read.extend(df.inputFiles())
        return df

    monkeypatch.setattr(incremental, "facts", recorded)
    monthly = incremental.report(spark, grown, "monthly", PARAMS)
    assert read and all("/part-b2/" in path for path in read)
    read.clear()
    assert incremental.update_states(spark, grown, "monthly", PARAMS) == [] and not read
    assert not any("/transactions/" in path for path in monthly.inputFiles())
    assert rows(monthly) == rows(export.export_monthly(tpch.events(spark, sf_dir)))


def test_other_parameters_have_states_of_their_own(spark, sf_dir, grown):
    from dataclasses import replace

    other = replace(PARAMS, gap=replace(PARAMS.gap, negative="before"))
    for p in (PARAMS, other):
        found = incremental.report(spark, grown, "labels", p)
        assert rows(found.select(*sorted(found.columns))) == rows(
            export.rollup_counts(tpch.events(spark, sf_dir), p).select(*sorted(found.columns))
        )


def test_a_batch_without_a_ledger_entry_is_not_seen(spark, logs, tmp_path):
    folder = str(tmp_path / "fact")
    assert incremental.facts(spark, folder).count() == 0 and incremental.report(spark, folder, "monthly").count() == 0
    incremental.append_batch(spark, folder, "a", {"offline_test": logs["offline_test"]})
    expected = rows(incremental.facts(spark, folder))
    incremental.append_batch(spark, folder, "b", {"online": logs["online"]})
    # As after a crash between the rows and the entry.
    delete_path(spark, f"{folder}/ledger/entry-b")
    assert rows(incremental.facts(spark, folder)) == expected
    assert incremental.append_batch(spark, folder, "b", {"online": logs["online"]})
    n = incremental.facts(spark, folder)
    assert n.count() == len(expected) + logs["online"].count() == n.select("transaction_id").distinct().count()


def test_states_of_parts_equal_the_whole(spark):
    spec = incremental.Partial(
        "t", lambda f, p: f, ("cell",), {"n": F.count("*")}, {"users": "user", "shops": "shop"}
    )
    data = [("a", u, u % 3) for u in (-5, -5, 0, 7, 40_000, 10**14, 10**14)] + [(None, 1, None), (None, None, None), ("b", None, 4)]
    df = spark.createDataFrame(data, "cell string, user long, shop long")
    halves = [incremental.state_of(df.where(c), spec) for c in ("coalesce(user, 0) % 2 = 0", "coalesce(user, 0) % 2 <> 0")]
    merged = incremental.merged(halves[0][0].union(halves[1][0]), halves[0][1].union(halves[1][1]), spec)
    assert rows(merged.select("cell", "n", "users", "shops")) == rows(
        df.groupBy("cell").agg(F.count("*"), F.count_distinct("user"), F.count_distinct("shop"))
    )
