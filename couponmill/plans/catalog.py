"""Every report and operator as a query over the TPC-H-like tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.functions.cleaning import with_discount
from couponmill.operators import ingest, integrity, ordering, rejects, star
from couponmill.params import ReportParams
from couponmill.plans import bucket, chart, export, incremental, liveview, merchant, rfm, summary, trend
from couponmill.schema import CANONICAL, RAW_SCHEMAS
from couponmill.session import scratch_folder, stage
from couponmill.sources import readers, tpch, writers

# The dates these tables cover.
PARAMS = replace(
    ReportParams(),
    window_start=date(2000, 1, 1),
    window_end=date(2000, 8, 1),
    chart_first_month="2000-01",
    chart_last_month="2000-07",
    ref_date=date(2001, 12, 31),
    default_date=date(1995, 1, 1),
)

Query = Callable[[SparkSession, str], DataFrame]


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as text, bytes as integers, for comparison across engines."""
    cols = []
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.ByteType):
            c = c.cast("int")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def _over_events(report: Callable[..., DataFrame], **options) -> Query:
    """A report on the events, with this data's parameters if it takes any."""
    takes_params = "p" in report.__code__.co_varnames[: report.__code__.co_argcount]
    if takes_params:
        options = {"p": PARAMS, **options}
    return lambda spark, sf_dir: portable(report(tpch.events(spark, sf_dir), **options))


def _over_merchants(report: Callable[..., DataFrame], **options) -> Query:
    """A report that joins the merchant dimension with the events."""
    return lambda spark, sf_dir: portable(
        report(tpch.dimensions(spark, sf_dir)["merchants"], tpch.events(spark, sf_dir), p=PARAMS, **options)
    )


def remaining(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    """Dimensions after a clean-up: overdrawn accounts closed, one product line withdrawn."""
    customers, suppliers, parts = (tpch.table(spark, sf_dir, n) for n in ("customer", "supplier", "part"))
    return {
        "users": (customers.where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id")), "user_id"),
        "merchants": (
            suppliers.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("merchant_id")),
            "merchant_id",
        ),
        "coupons": (
            parts.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("coupon_id")),
            "coupon_id",
        ),
    }


def _dim_coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(star.coupon_dimension(tpch.events(spark, sf_dir), tpch.EVENT_ORDER))


def _table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.table_counts({**tpch.dimensions(spark, sf_dir), "transactions": tpch.events(spark, sf_dir)})


def _orphan_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim, key = remaining(spark, sf_dir)["merchants"]
    return integrity.orphans(tpch.events(spark, sf_dir), dim, key)


def _cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim, key = remaining(spark, sf_dir)["merchants"]
    kept = integrity.cascade(tpch.events(spark, sf_dir), dim, key)
    return kept.groupBy("source", "discount_type").agg(
        F.count("*").alias("row_count"), F.count_distinct("merchant_id").alias("merchants")
    )


def _set_null_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim, key = remaining(spark, sf_dir)["coupons"]
    before = tpch.events(spark, sf_dir).withColumn("had_coupon", F.col("coupon_id").isNotNull())
    return (
        integrity.set_null_missing(before, dim, key)
        .groupBy("source")
        .agg(
            F.count("*").alias("row_count"),
            F.count_distinct("coupon_id").alias("coupons"),
            F.count_if(F.col("had_coupon") & F.col("coupon_id").isNull()).alias("cleared"),
        )
    )


def _merchant_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = merchant.merchant_counts(tpch.events(spark, sf_dir), PARAMS)
    stats = merchant.merchant_stats(counts, PARAMS.full_rank_min_received).select("merchant_id", "received_cnt", "used_cnt", "usage_rate")
    return portable(ordering.rank_all(stats, "-usage_rate", ["merchant_id"]))


def _merchants_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tpch.events(spark, sf_dir)
    above = merchant.merchants_above(f, 0.39, PARAMS.mix_min_received, PARAMS)
    return (
        merchant.facts_of_merchants(f, above)
        .groupBy("merchant_id")
        .agg(F.count("*").alias("row_count"), F.count("date_used").alias("used_cnt"))
    )


def _coupon_mix_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coupon mix of the merchants left, with a floor and a minimum that some of them miss."""
    dim, _ = remaining(spark, sf_dir)["merchants"]
    p = replace(PARAMS, mix_rate_floor=0.39, mix_min_received=490)
    return portable(merchant.high_rate_coupon_mix(tpch.events(spark, sf_dir), p, dim))


def _discount_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as rates, order totals as thresholds and reductions, and tiny amounts: many do not fit the declared decimals."""
    lines, orders = (tpch.table(spark, sf_dir, n) for n in ("lineitem", "orders"))
    text = """CASE l_linenumber % 5
        WHEN 0 THEN cast(cast(l_extendedprice AS decimal(14,2)) AS string)
        WHEN 1 THEN concat(cast(cast(o_totalprice * 1000 AS decimal(18,2)) AS string), ':5')
        WHEN 2 THEN concat('100:', cast(cast(l_extendedprice AS decimal(14,2)) AS string))
        WHEN 3 THEN concat('5:', cast(cast(o_totalprice * 1000 AS decimal(18,2)) AS string))
        WHEN 4 THEN CASE l_suppkey % 2
            WHEN 1 THEN concat('0.0000', l_suppkey % 9 + 1) ELSE concat('0.00', l_suppkey % 9 + 1, ':5') END
    END AS discount_rate"""
    return integrity.discount_overflow(with_discount(lines.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(text)))


def write_broken_logs(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """The events as raw logs in which some lines and values cannot be read; returns the path of each."""
    log = tpch.event_log(spark, sf_dir).withColumn("n", F.col("user_id") + F.col("merchant_id"))
    text = {
        "User_id": "CASE WHEN n % 13 = 0 THEN 'none' ELSE cast(user_id AS string) END",
        "Merchant_id": "merchant_id",
        "Action": "CASE WHEN n % 17 = 1 THEN 9 ELSE action END",
        "Coupon_id": "coalesce(coupon_id, 'null')",
        "Discount_rate": "CASE WHEN n % 19 = 2 THEN '15000' ELSE discount_rate END",
        "Distance": "CASE WHEN n % 7 = 3 THEN 'far' WHEN n % 7 = 4 THEN 'N/A' ELSE cast(distance AS string) END",
        "Date_received": "CASE WHEN n % 11 = 5 THEN '20001399' ELSE date_format(date_received, 'yyyyMMdd') END",
        "Date": "CASE WHEN n % 5 = 4 THEN 'soon' ELSE date_format(date_used, 'yyyyMMdd') END",
    }
    paths = {}
    for source in ingest.SOURCES:
        paths[source] = f"{folder}/{source}"
        rows = log.where(F.col("source") == source).selectExpr(*[f"{text[c]} AS {c}" for c in RAW_SCHEMAS[source].names])
        rows.write.option("header", True).option("nullValue", "null").csv(paths[source])
    return paths


def _ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading the broken logs loses, and the rows that are left."""
    paths = write_broken_logs(spark, sf_dir, scratch_folder(spark))
    logs = {source: readers.read_raw(spark, path, source, keep_broken=True) for source, path in paths.items()}
    fact, lost = rejects.build_fact_counted(logs)
    # By distinct id, as every row left has one of its own.
    left = fact.groupBy("source").agg(F.count_distinct("transaction_id").alias("row_count"))
    return lost.unionByName(left.select("source", F.lit("kept").alias("field"), "row_count"))


_LOADED = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType()),
])


def _bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a quoted CSV; overdrawn ones have an empty name."""
    name = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("c_name")
    path = scratch_folder(spark)
    writers.write_csv(tpch.table(spark, sf_dir, "customer").select("c_custkey", name, "c_acctbal", "c_mktsegment"), path)
    return readers.load_table(spark, path, _LOADED)


def _csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in two parts, the second appended."""
    customers = tpch.table(spark, sf_dir, "customer").select(*_LOADED.names)
    path = scratch_folder(spark)
    writers.write_csv(customers.where("c_acctbal < 0"), path)
    writers.write_csv(customers.where("c_acctbal >= 0"), path, mode="append")
    return readers.load_table(spark, path, _LOADED)


def _rfm_tsv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RFM segments written as TSV and read back with their schema."""
    segments = portable(rfm.rfm_segments(tpch.events(spark, sf_dir), PARAMS))
    path = scratch_folder(spark)
    writers.write_csv(segments, path, bom=False, sep="\t")
    return readers.read_tsv(spark, path, segments.schema)


def _sorted_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants written in key order and read back."""
    path = scratch_folder(spark)
    writers.write_sorted(tpch.dimensions(spark, sf_dir)["merchants"], "merchant_id", path)
    return readers.read_fact(spark, path)


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a sample of orders, counting only rows that the table has."""
    orders = tpch.table(spark, sf_dir, "orders")
    sample = writers.sample_rows(orders.select("o_orderkey"), 10)
    return sample.join(orders, "o_orderkey", "left_semi").agg(F.count("*").alias("row_count"))


def _growth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(chart.growth_points(chart.monthly_chart(tpch.events(spark, sf_dir), PARAMS)))


def _export_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_rfm(rfm.rfm_view(tpch.events(spark, sf_dir), PARAMS))


def _sql_monthly_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers.register_tables({"transactions": tpch.events(spark, sf_dir)})
    return readers.run_query(
        spark,
        "monthly uses",
        """
        SELECT date_format(date_used, 'yyyy-MM') AS ym, count(*) AS used_count
        FROM transactions
        WHERE source <> 'offline_test' AND date_used >= :start AND date_used < :end
        GROUP BY 1 ORDER BY ym
        """,
        {"start": PARAMS.window_start, "end": PARAMS.window_end},
    )


def write_raw_logs(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """The events as three raw logs in CSV, each in event order; returns the path of each."""
    log = stage(tpch.event_log(spark, sf_dir))
    raw_names = {v: k for k, v in CANONICAL.items()}
    dates = {c: F.date_format(c, "yyyyMMdd") for c in ("Date_received", "Date")}
    paths = {}
    for source in ingest.SOURCES:
        paths[source] = f"{folder}/{source}"
        ordered = log.where(F.col("source") == source).orderBy(*ordering.sort_columns(tpch.EVENT_ORDER))
        rows = ordered.withColumnsRenamed(raw_names).withColumns(dates).select(RAW_SCHEMAS[source].names)
        rows.write.option("header", True).option("nullValue", "null").csv(paths[source])
    return paths


def _raw_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw logs taken in again."""
    paths = write_raw_logs(spark, sf_dir, scratch_folder(spark))
    return ingest.build_fact(*(readers.read_raw(spark, path, source) for source, path in paths.items()))


def _raw_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its id: the rows of the logs in order, one log after another."""
    return portable(_raw_fact(spark, sf_dir))


def _raw_ingest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids run through the sources in order, without gaps."""
    return _raw_fact(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("row_count"),
        F.min("transaction_id").alias("first_id"),
        F.max("transaction_id").alias("last_id"),
        F.count_distinct("transaction_id").alias("ids"),
    )


def _order_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decile edges of two amounts, one that hardly repeats and one that often does, in thousandths, and whether the sketch alone is near enough."""
    amounts = tpch.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), (F.col("o_custkey") % 7).alias("weekday")
    )
    exact = ordering.quantile_edges(amounts, ["total", "weekday"], [], 10)
    near = ordering.sketch_edges(amounts, ["total", "weekday"], [], 10)
    rows = []
    for metric, edges in exact.items():
        error = ordering.rank_error(amounts, metric, near[metric])
        rows += [(metric, j, round(edge * 1000), error <= 1 / ordering.SKETCH_ACCURACY + 1e-9) for j, edge in enumerate(edges)]
    return spark.createDataFrame(rows, "metric string, decile int, thousandths long, sketch_near boolean")


def _in_order(query: Query, *columns: str) -> Query:
    """The place of every row in the order in which a report gives them."""
    return lambda spark, sf_dir: ordering.with_position(query(spark, sf_dir)).select("position", *columns)


def _ordered_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users written in key order, with the place of each in the files as they lie: file by file, row by row."""
    path = scratch_folder(spark)
    users = tpch.dimensions(spark, sf_dir)["users"].repartition(4)
    writers.write_sorted(users, "user_id", path)
    lying = spark.read.parquet(path).select("user_id", "_metadata.file_name", "_metadata.row_index")
    return ordering.with_row_id(lying, ["file_name", "row_index"], "position").select("position", "user_id")


def _new_name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


def _stored_in_parts(spark: SparkSession, sf_dir: str, name: str) -> Callable[[], None]:
    """A table of a third of the events' users; the returned call appends the others."""
    f = tpch.events(spark, sf_dir)
    writers.replace_table(f.where("user_id % 3 = 0"), name)
    return lambda: writers.replace_table(f.where("user_id % 3 <> 0"), name, mode="append")


def _rfm_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view made over a part of the fact, read after the rest was appended."""
    name = _new_name("fact")
    append = _stored_in_parts(spark, sf_dir, name)
    liveview.register_live_rfm_view(spark, name, f"{name}_rfm", PARAMS)
    append()
    return portable(spark.table(f"{name}_rfm"))


def _summary_follows_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary stored over a part of the fact and asked for after the rest was appended."""
    name = _new_name("fact")
    append = _stored_in_parts(spark, sf_dir, name)
    summary.materialize_summary(spark.table(name), "summary_monthly_trend", PARAMS)
    append()
    return portable(summary.current_summary(spark.table(name), "summary_monthly_trend", PARAMS))


def grown_fact(spark: SparkSession, sf_dir: str, folder: str, between: Callable[[], None] = lambda: None) -> None:
    """The raw logs added in two batches under ``folder``, the first of them twice; ``between`` is called after each."""
    paths = write_raw_logs(spark, sf_dir, scratch_folder(spark))
    logs = {source: readers.read_raw(spark, path, source) for source, path in paths.items()}
    first = {"online": logs["online"]}
    for batch, part in (("b1", first), ("b1", first), ("b2", {k: v for k, v in logs.items() if k != "online"})):
        incremental.append_batch(spark, folder, batch, part)
        between()


def _incremental_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    grown_fact(spark, sf_dir, folder)
    return portable(incremental.facts(spark, folder))


def _incremental(report: str) -> Query:
    """A report whose states are built as the batches come."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_folder(spark)
        grown_fact(spark, sf_dir, folder, lambda: incremental.update_states(spark, folder, report, PARAMS))
        return portable(incremental.report(spark, folder, report, PARAMS))

    return query


def _csv_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers appended in two batches, the first of them twice."""
    customers = tpch.table(spark, sf_dir, "customer").select(*_LOADED.names)
    path = scratch_folder(spark)
    for batch, rows in (("b1", "c_acctbal < 0"), ("b1", "c_acctbal < 0"), ("b2", "c_acctbal >= 0")):
        writers.append_csv_once(customers.where(rows), path, batch)
    return readers.load_table(spark, path, _LOADED)


def _failed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers after a second load that failed at one of its rows."""
    name = _new_name("suppliers")
    rows = tpch.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    writers.replace_table(rows, name)
    broken = F.when(F.col("s_suppkey") == 7, F.raise_error(F.lit("broken row")).cast("string")).otherwise("new")
    try:
        writers.replace_table(rows.withColumn("s_name", broken), name)
    except Exception as error:  # noqa: BLE001 - the load has to fail
        if "broken row" not in str(error):
            raise
        return spark.table(name)
    raise RuntimeError("the load should have failed")


def _table_as_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made from a query, then from one with other columns that reads the first."""
    name = _new_name("accounts")
    customers = tpch.table(spark, sf_dir, "customer")
    first = writers.materialize(customers.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("customers")), name)
    return writers.materialize(first.groupBy("c_mktsegment").agg(F.sum("customers").alias("customers")), name)


def _load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the tables are loaded, and their rows."""
    tables = {**tpch.dimensions(spark, sf_dir), "transactions": tpch.events(spark, sf_dir)}
    prefix = _new_name("load")
    loaded = writers.load_tables({f"{prefix}_{name}": df for name, df in tables.items()})
    return loaded.withColumn("table_name", F.substring("table_name", len(prefix) + 2, 100))


QUERIES: dict[str, Query] = {
    "ordered_by_metric": _in_order(_over_merchants(merchant.merchant_usage), "merchant_id"),
    "ordered_by_key": _in_order(_over_events(export.export_monthly), "year_month"),
    "ordered_by_label": _in_order(_over_events(bucket.gap_distribution), "gap_bucket"),
    "ordered_dimension": _ordered_dimension,
    "ingest_rejects": _ingest_rejects,
    "order_quantiles": _order_quantiles,
    "rfm_live_view": _rfm_live_view,
    "summary_follows_fact": _summary_follows_fact,
    "incremental_fact": _incremental_fact,
    "incremental_monthly": _incremental("monthly"),
    "incremental_day_type": _incremental("day_type"),
    "incremental_labels": _incremental("labels"),
    "csv_append_once": _csv_append_once,
    "failed_replace": _failed_replace,
    "table_as_select": _table_as_select,
    "load_order": _load_order,
    "raw_ingest": _raw_ingest,
    "raw_ingest_ids": _raw_ingest_ids,
    "dim_users": _over_events(star.dimension, key="user_id"),
    "dim_merchants": _over_events(star.dimension, key="merchant_id"),
    "dim_coupons": _dim_coupons,
    "fact_transactions": lambda spark, sf_dir: portable(tpch.transactions(spark, sf_dir)),
    "table_counts": _table_counts,
    "orphan_report": lambda spark, sf_dir: integrity.orphan_report(
        tpch.events(spark, sf_dir), remaining(spark, sf_dir)
    ),
    "orphan_merchants": _orphan_merchants,
    "duplicate_key_report": lambda spark, sf_dir: integrity.duplicate_keys(
        tpch.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    ),
    "cascade_delete": _cascade_delete,
    "set_null_missing": _set_null_missing,
    "invalid_values": _over_events(integrity.invalid_values, c="source", allowed=("online", "offline")),
    "merchant_usage": _over_merchants(merchant.merchant_usage),
    "merchant_usage_min50": _over_merchants(merchant.merchant_usage, min_received=50),
    "merchant_usage_min490": _over_merchants(merchant.merchant_usage, min_received=490),
    "merchant_rank": _over_merchants(merchant.merchant_rank),
    "merchant_rank_full": _over_events(merchant.merchant_rank_full),
    "merchant_rank_all": _merchant_rank_all,
    "high_rate_coupon_mix": _over_events(merchant.high_rate_coupon_mix),
    "high_rate_coupon_mix_remaining": _coupon_mix_remaining,
    "discount_overflow": _discount_overflow,
    "bulk_load": _bulk_load,
    "csv_append": _csv_append,
    "rfm_tsv_segments": _rfm_tsv_segments,
    "sorted_dimension": _sorted_dimension,
    "sample_rows": _sample_rows,
    "pruned_scan": lambda spark, sf_dir: readers.read_fact(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_type"]),
    "growth_points": _growth_points,
    "merchant_monthly": _over_events(trend.merchant_monthly),
    "merchants_above_semi_join": _merchants_above,
    "overall_stats": _over_events(merchant.overall_stats),
    "monthly_growth": _over_events(trend.monthly_growth),
    "merchant_monthly_growth": _over_events(trend.merchant_monthly_growth),
    "daily_moving_avg": _over_events(trend.daily_moving_avg),
    "month_first_last": _over_events(trend.month_first_last),
    "monthly_trend": _over_events(trend.monthly_trend),
    "weekly_growth": _over_events(trend.weekly_growth),
    "day_type_usage": _over_events(trend.day_type_usage),
    "coupon_type": _over_events(bucket.coupon_type),
    "coupon_type_short": _over_events(bucket.coupon_type_short),
    "threshold_usage": _over_events(bucket.threshold_usage),
    "distance_usage": _over_events(bucket.distance_usage),
    "gap_distribution": _over_events(bucket.gap_distribution),
    "summary_merchant_usage": _over_events(summary.summary_merchant_usage),
    "summary_monthly_trend": _over_events(summary.summary_monthly_trend),
    "summary_coupon_type": _over_events(summary.summary_coupon_type),
    "summary_rfm_scores": _over_events(summary.summary_rfm_scores),
    "summary_threshold_bucket": _over_events(summary.summary_threshold_bucket),
    "summary_gap_analysis": _over_events(summary.summary_gap_analysis),
    "rfm_user_base": _over_events(rfm.user_base),
    "rfm_users": _over_events(rfm.rfm_users),
    "rfm_segments": _over_events(rfm.rfm_segments),
    "rfm_view": _over_events(rfm.rfm_view),
    "rfm_qcut": _over_events(rfm.rfm_qcut),
    "rfm_qcut_compat": _over_events(rfm.rfm_qcut, compat=True),
    "rfm_qcut_segments": _over_events(rfm.rfm_qcut_segments),
    "top_merchants_chart": _over_events(chart.top_merchants_chart),
    "rfm_distribution_chart": _over_events(chart.rfm_distribution_chart),
    "rfm_distribution_chart_compat": _over_events(chart.rfm_distribution_chart, compat=True),
    "monthly_chart": _over_events(chart.monthly_chart),
    "coupon_type_chart": _over_events(chart.coupon_type_chart),
    "enriched": _over_events(export.enrich),
    "rollup_counts": _over_events(export.rollup_counts),
    "export_monthly": _over_events(export.export_monthly),
    "export_coupon_type": _over_events(export.export_coupon_type),
    "export_distance": _over_events(export.export_distance),
    "export_day_type": _over_events(export.export_day_type),
    "export_gap": _over_events(export.export_gap),
    "export_threshold": _over_events(export.export_threshold),
    "export_rfm": _export_rfm,
    "kpi_overview": _over_events(export.kpi_overview),
    "sql_monthly_uses": _sql_monthly_uses,
}
