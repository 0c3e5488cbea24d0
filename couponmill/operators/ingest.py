"""Raw logs to one cleaned, typed, numbered log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponmill.functions.cleaning import action_name, null_tokens, parse_day, parse_num, with_discount
from couponmill.operators.ordering import sized_broadcast
from couponmill.schema import CANONICAL, LOG_COLUMNS, TRANSACTIONS
from couponmill.session import pin, stage

# Source tags in the order their rows are numbered.
SOURCES = ("online", "offline", "offline_test")

POSITION_COLUMNS = ("_source_rank", "_file", "_block", "_seq")


def tag(df: DataFrame, source: str) -> DataFrame:
    """Mark the rows with their source."""
    return df.withColumn("source", F.lit(source))


def canonical(df: DataFrame) -> DataFrame:
    """Star-schema column names."""
    return df.withColumnsRenamed({k: v for k, v in CANONICAL.items() if k in df.columns})


def project(df: DataFrame, cols: list[str] | tuple[str, ...]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    present = set(df.columns)
    return df.select(*[c for c in cols if c in present])


def clean_log(df: DataFrame, source: str) -> DataFrame:
    """One raw log with canonical names, typed dates, distance and action name."""
    out = canonical(tag(df, source))
    out = null_tokens(out, [c for c in ("coupon_id", "discount_rate", "distance") if c in out.columns])
    derived = {c: parse_day(c) for c in ("date_received", "date_used") if c in out.columns}
    if "distance" in out.columns:
        derived["distance"] = parse_num("distance").try_cast("int")
    if "action" in out.columns:
        derived["action_name"] = action_name("action")
    return out.withColumns(derived)


def align(df: DataFrame) -> DataFrame:
    """All log columns in fixed order; the missing ones as typed NULLs."""
    types = {field.name: field.dataType for field in TRANSACTIONS}
    extra = [c for c in POSITION_COLUMNS if c in df.columns]
    return df.select(
        *[
            F.col(c).cast(types[c]).alias(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
            for c in LOG_COLUMNS
        ],
        *extra,
    )


def union_logs(logs: dict[str, DataFrame], clean: Callable[[DataFrame, str], DataFrame] = clean_log) -> DataFrame:
    """Cleaned logs as one, by source; a batch need not have all of them."""
    parts = [
        align(clean(logs[source], source)).withColumn("_source_rank", F.lit(rank))
        for rank, source in enumerate(SOURCES)
        if source in logs
    ]
    return reduce(DataFrame.unionByName, parts)


def union_sources(online: DataFrame, offline: DataFrame, test: DataFrame) -> DataFrame:
    """The three cleaned logs as one."""
    return union_logs(dict(zip(SOURCES, (online, offline, test))))


def with_input_ids(
    logs: DataFrame, name: str = "transaction_id", put: Callable[[DataFrame], DataFrame] = stage
) -> DataFrame:
    """Consecutive 1..N in input order: source, then file, then line.

    ``logs`` carries the position columns of ``read_raw(position=True)`` and is
    written by ``put``, so the ids stay the same for every later job.  Rows are not
    moved: each file block gets an offset and its rows count on from it.
    """
    placed = put(logs)
    block = ["_source_rank", "_file", "_block"]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file block read.
    blocks = pin(placed.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first")))
    offsets = blocks.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    kept = [c for c in logs.columns if c not in POSITION_COLUMNS]
    return placed.join(sized_broadcast(offsets), block).select(
        (F.col("_offset") + F.col("_seq") - F.col("_first") + 1).alias(name), *kept
    )


def canonical_fact(df: DataFrame) -> DataFrame:
    """Exactly the declared fact columns and types."""
    return df.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in TRANSACTIONS])


def build_fact(
    online: DataFrame, offline: DataFrame, test: DataFrame, put: Callable[[DataFrame], DataFrame] = stage
) -> DataFrame:
    """The transactions fact from the three raw logs."""
    return canonical_fact(with_discount(with_input_ids(union_sources(online, offline, test), put=put)))
