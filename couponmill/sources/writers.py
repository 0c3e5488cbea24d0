"""Writers and table management."""

from __future__ import annotations

import logging
import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.functions.sqltext import literal
from couponmill.operators.star import Star
from couponmill.schema import COUPONS, MERCHANTS, TRANSACTIONS, USERS
from couponmill.session import delete_path, folders_in, path_exists
from couponmill.sources.readers import MARK, read_fact

log = logging.getLogger(__name__)

BOM = "﻿"


def write_csv(
    df: DataFrame, path: str, mode: str = "overwrite", bom: bool = True, single_file: bool = False, sep: str = ","
) -> None:
    """CSV with header, by default marked as UTF-8.

    One distributed write; ``mode="append"`` adds to earlier files.  Use
    ``single_file`` only for aggregated results of a few rows.
    """
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    if single_file:
        df = df.coalesce(1)
    df.write.mode(mode).option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def write_sorted(df: DataFrame, key: str, path: str) -> None:
    """Parquet in key order (range-partitioned sort)."""
    df.orderBy(key).write.mode("overwrite").parquet(path)


def set_mark(spark: SparkSession, name: str, mark: str | None) -> None:
    """Note on a table with which parameters and data it was built; None removes it."""
    change = f"SET TBLPROPERTIES ({literal(MARK)} = {literal(mark)})" if mark else f"UNSET TBLPROPERTIES IF EXISTS ({literal(MARK)})"
    spark.sql(f"ALTER TABLE IDENTIFIER(:name) {change}", {"name": name})


def _versions(spark: SparkSession, name: str) -> str:
    """Folder of the versions of a table."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/{name.replace('.', '/')}.versions"


def _switch(spark: SparkSession, name: str, folder: str, schema: T.StructType) -> None:
    """Let the table read ``folder``: one change of the catalog if the columns stay the same."""
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    if spark.catalog.tableExists(name):
        now = T.StructType([T.StructField(f.name, f.dataType) for f in spark.table(name).schema])
        if now == plain:
            # Without a mark while the rows change, so it never describes other rows.
            set_mark(spark, name, None)
            spark.sql(f"ALTER TABLE IDENTIFIER(:name) SET LOCATION {literal(folder)}", {"name": name})
            spark.catalog.refreshTable(name)
            return
        spark.sql("DROP TABLE IDENTIFIER(:name)", {"name": name})
    spark.catalog.createTable(name, path=folder, source="parquet", schema=plain)


def replace_table(df: DataFrame, name: str, mode: str = "overwrite", mark: str | None = None) -> int:
    """Replace (or append to) a table in one write; returns the rows written.

    The rows are written beside the table, which is then pointed at them, so a
    load that fails leaves the old rows in place, and ``df`` may read the table
    itself.  The version before stays for queries that still read it; older ones are
    removed.  Replacing removes an older mark, so a table never has one it was not
    written under.
    """
    spark, started = df.sparkSession, time.time()
    seen = Observation(f"load_{name}")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if mode == "append":
        counted.write.mode("append").saveAsTable(name)
    else:
        versions = _versions(spark, name)
        before = folders_in(spark, versions)
        folder = f"{versions}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        try:
            counted.write.parquet(folder)
        except Exception:
            delete_path(spark, folder)
            raise
        _switch(spark, name, folder, df.schema)
        for old in before[:-1]:
            delete_path(spark, f"{versions}/{old}")
    if mark is not None:
        set_mark(spark, name, mark)
    rows = seen.get["rows"]
    log.info("%s: %d rows in %.1f s", name, rows, time.time() - started)
    return rows


def materialize(df: DataFrame, name: str, mark: str | None = None) -> DataFrame:
    """Create table as select, replacing an older one the way :func:`replace_table` does."""
    replace_table(df, name, mark=mark)
    return df.sparkSession.table(name)


def load_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Replace tables one after another, in the order given; ``position``, ``table_name`` and ``row_count`` of each.

    Give dimensions before the fact: a load that fails leaves the tables after it
    as they were, so the fact is never newer than its dimensions.
    """
    rows = [(i, name, replace_table(df, name)) for i, (name, df) in enumerate(tables.items(), 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "position int, table_name string, row_count long")


def append_csv_once(df: DataFrame, path: str, batch: str) -> bool:
    """Append a batch of rows to a CSV result; False, and nothing written, if that batch is there already.

    Every batch is a folder of its own under ``path``, complete once Spark has marked it so;
    a batch that failed midway is written again from the start.
    """
    folder = f"{path}/batch={batch_name(batch)}"
    if path_exists(df.sparkSession, f"{folder}/_SUCCESS"):
        return False
    write_csv(df, folder)
    return True


def batch_name(batch: str) -> str:
    """``batch``, if it can name a folder."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"a batch needs a name of letters, digits, '_', '.' and '-', not {batch!r}")
    return batch


def save_dimensions(star: Star, folder: str) -> None:
    """The three dimensions as Parquet in key order under ``folder``."""
    write_sorted(star.users, "user_id", f"{folder}/users")
    write_sorted(star.merchants, "merchant_id", f"{folder}/merchants")
    write_sorted(star.coupons, "coupon_id", f"{folder}/coupons")


def save_fact(fact: DataFrame, folder: str, partition_by: tuple[str, ...] = ("source",)) -> None:
    """The fact as Parquet under ``folder``.

    It is split by source, which nearly every report filters on, and every
    file is in the order of the day of use, so a report on a range of days
    skips the other row groups.  No row is moved between tasks.
    """
    ordered = fact.sortWithinPartitions(*partition_by, "date_used")
    ordered.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/transactions")


def save_star(star: Star, folder: str, partition_by: tuple[str, ...] = ("source",)) -> None:
    """Parquet tables under ``folder``, dimensions before the fact."""
    save_dimensions(star, folder)
    save_fact(star.transactions, folder, partition_by)


def load_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The fact written by ``save_fact``."""
    return read_fact(spark, f"{folder}/transactions", schema=TRANSACTIONS)


def load_star(spark: SparkSession, folder: str) -> Star:
    """The tables written by ``save_star``, with their declared schemas."""
    declared = {"users": USERS, "merchants": MERCHANTS, "coupons": COUPONS}
    dimensions = {name: read_fact(spark, f"{folder}/{name}", schema=schema) for name, schema in declared.items()}
    return Star(**dimensions, transactions=load_fact(spark, folder))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ],
    )


def describe_tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """Tables of the current database whose name matches ``pattern``."""
    return spark.sql(f"SHOW TABLES LIKE {literal(pattern)}").select("tableName", "isTemporary")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """Columns and types of one table."""
    return spark.sql("DESCRIBE TABLE IDENTIFIER(:name)", {"name": name}).select("col_name", "data_type")


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows met."""
    return df.limit(n)
