"""The transactions fact expressed over TPC-H-like tables.

Order lines stand for coupon events: the customer is the user, the supplier the
merchant, the part the coupon.  The joins are 1:1 with the order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponmill.functions.cleaning import action_name, with_discount
from couponmill.operators.ingest import canonical_fact
from couponmill.operators.ordering import with_row_id

# A total order over distinct events; the derived discount columns add nothing to it.
EVENT_ORDER = [
    "user_id", "merchant_id", "coupon_id", "discount_rate", "source", "distance",
    "date_received", "date_used", "action",
]


# Declared columns, so that opening a table reads no footer.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}

EVENTS = [
    "o_custkey AS user_id",
    "l_suppkey AS merchant_id",
    "CASE WHEN l_discount > 0 THEN cast(l_partkey AS string) END AS coupon_id",
    """CASE
        WHEN l_discount = 0 THEN NULL
        WHEN p_size % 10 = 0 THEN 'fixed'
        WHEN l_linenumber % 2 = 1 THEN concat(p_size * 12, ':', p_size)
        ELSE cast(round(1 - l_discount, 2) AS string)
    END AS discount_rate""",
    # The test source wins over the order status.
    "CASE WHEN l_linenumber = 7 THEN 'offline_test' WHEN o_orderstatus = 'P' THEN 'online' ELSE 'offline' END AS source",
    "CASE WHEN o_orderstatus <> 'P' AND p_size <= 45 THEN p_size % 13 END AS distance",
    "CASE WHEN l_discount > 0 THEN cast(o_orderdate AS date) END AS date_received",
    """CASE
        WHEN l_linenumber = 7 THEN NULL
        WHEN l_discount <= 0 THEN cast(o_orderdate AS date)
        WHEN l_returnflag = 'R' THEN date_add(cast(o_orderdate AS date), cast(l_quantity AS int) - 5)
    END AS date_used""",
    """CASE WHEN l_linenumber <> 7 AND o_orderstatus = 'P' THEN
        cast(CASE WHEN l_discount <= 0 OR l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS tinyint)
    END AS action""",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events before their discount is parsed."""
    lines, orders, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(parts, F.expr("l_partkey = p_partkey"))
    return joined.selectExpr(*EVENTS)


def _parsed(log: DataFrame) -> DataFrame:
    return with_discount(log).withColumn("action_name", action_name("action"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact without transaction ids."""
    return _parsed(event_log(spark, sf_dir))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fact, numbered in event order before the discount is parsed."""
    return canonical_fact(_parsed(with_row_id(event_log(spark, sf_dir), EVENT_ORDER, "transaction_id")))


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stored key tables: every registered user, merchant and coupon."""
    return {
        "users": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id")),
        "merchants": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("merchant_id")),
        "coupons": table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("coupon_id")),
    }
