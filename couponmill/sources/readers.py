"""Readers with declared schemas."""

from __future__ import annotations

import hashlib
import logging
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.schema import RAW_SCHEMAS

log = logging.getLogger(__name__)

# Table property that tells with which parameters a table was built.
MARK = "couponmill.parameters"


# Column that holds a line which does not fit the declared columns.
BROKEN_LINE = "_broken_line"


def read_raw(
    spark: SparkSession, path: str, kind: str, position: bool = True, mode: str = "FAILFAST", keep_broken: bool = False
) -> DataFrame:
    """A raw behaviour log (``online``, ``offline`` or ``offline_test``).

    ``position`` adds the file, block and row position that number the rows in
    input order.  A line that does not fit the declared columns ends the
    load; with ``keep_broken`` it comes as a row with the line in BROKEN_LINE instead.
    """
    schema = RAW_SCHEMAS[kind]
    reader = spark.read.option("header", True).option("nullValue", "null")
    if keep_broken:
        schema = T.StructType([*schema.fields, T.StructField(BROKEN_LINE, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN_LINE)
    else:
        reader = reader.option("mode", mode)
    df = reader.schema(schema).csv(path)
    if not position:
        return df
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def read_fact(
    spark: SparkSession, path: str, cols: list[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """A stored table, pruned to ``cols`` at the scan, by default in the types it was stored with."""
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A tab-separated query result with a header."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A quoted CSV loaded by column name: empty text is NULL, bad values are NULL.

    Declared columns the file lacks come out as NULL.
    """
    text = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    present = {c.lstrip("﻿").lower(): c for c in text.columns}
    cols = []
    for field in schema:
        if field.name in present:
            value = F.nullif(F.col(f"`{present[field.name]}`"), F.lit("")).try_cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        cols.append(value.alias(field.name))
    return text.select(*cols)


def register_tables(tables: dict[str, DataFrame]) -> None:
    """Temporary views under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_query(spark: SparkSession, label: str, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """SQL text over registered views, with named parameters.  Errors are raised."""
    df = spark.sql(sql, args=args or {})
    log.info("[%s] %d columns: %s", label, len(df.columns), ", ".join(df.columns))
    return df


def table_mark(spark: SparkSession, name: str) -> str | None:
    """What the table was marked with when it was written."""
    properties = spark.sql("SHOW TBLPROPERTIES IDENTIFIER(:name)", {"name": name}).where(F.col("key") == MARK)
    row = properties.select("value").first()
    return row.value if row else None


def data_mark(df: DataFrame) -> str:
    """The same text as long as the files that ``df`` reads are the same.

    Names, sizes and times of the files are listed and hashed by Spark; no file is
    opened.  A frame that reads no file has a mark of its own every time.
    """
    files = df.inputFiles()
    if not files:
        return uuid.uuid4().hex
    listed = df.sparkSession.read.format("binaryFile").load(files)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = listed.agg(F.count("*"), F.sum("length"), F.sum(mark)).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def summary_or_compute(
    spark: SparkSession, name: str, compute: Callable[[], DataFrame], mark: str | None = None
) -> DataFrame:
    """The prepared summary table if it exists, else the report itself.

    With ``mark``, a table written under another mark or none is not used.  A
    mark has the parameters and, after a colon, the data; given without data, any data will do.
    """
    if spark.catalog.tableExists(name):
        stored = table_mark(spark, name) if mark is not None else None
        if mark is None or stored == mark or (stored and ":" not in mark and stored.split(":")[0] == mark):
            return spark.table(name)
    return compute()
