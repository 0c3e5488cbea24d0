"""Key integrity, re-expressed as joins: reports and rebuilds instead of constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponmill.operators.keyed import keyed_join
from couponmill.params import DISCOUNT_TYPES


def orphans(f: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows per key that is missing in the dimension.

    The fact is counted by key first, so a hot key is one row when it is joined.
    """
    counted = f.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("row_count"))
    return counted.join(dim.select(key).distinct(), key, "left_anti")


def orphan_report(f: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per dimension: distinct missing keys and the fact rows that carry them.

    ``dims`` maps a table name to (dimension, key).  Each key is counted by
    itself in its own type, so a scan reads one column and its shuffle holds
    one row per key and task.
    """
    return reduce(
        DataFrame.unionByName, [_orphan_totals(f, dim, key, name) for name, (dim, key) in dims.items()]
    ).orderBy("dimension")


def _orphan_totals(f: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    counted = f.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("row_count"))
    known = dim.select(key, F.lit(True).alias("known")).distinct()
    missing = F.col("known").isNull()
    return (
        counted.join(known, key, "left")
        .groupBy(F.lit(name).alias("dimension"))
        .agg(
            F.count(key).alias("key_count"),
            F.count_if(missing).alias("missing_keys"),
            F.coalesce(F.sum(F.when(missing, F.col("row_count"))), F.lit(0)).alias("orphan_rows"),
        )
    )


def cascade(f: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """The fact without rows whose key is no longer in the dimension."""
    return keyed_join(f, dim, key, "left_semi")


def set_null_missing(f: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """The fact with its key set to NULL where the dimension lacks it."""
    kept = F.when(F.col("_known"), F.col(key)).alias(key)
    return keyed_join(f, dim, key, "left").select(*[kept if c == key else F.col(c) for c in f.columns])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def discount_losses(c: str = "discount_rate", eq_rate: str = "discount_eq_rate") -> dict[str, Column]:
    """For each amount of a parsed discount: true where the declared decimals cannot hold it.

    An amount beyond them is NULL, one too small for them is 0 although the text is not.
    """
    threshold = F.substring_index(c, ":", 1).try_cast("double")
    reduction = F.substring_index(F.substring_index(c, ":", 2), ":", -1).try_cast("double")
    fixed, plain = F.col("discount_type") == "fixed", F.col("discount_type") == "discount"

    def lost(stored: str, parsed: Column) -> Column:
        return F.col(stored).isNull() | ((F.col(stored) == 0) & (parsed != 0))

    return {
        "threshold": fixed & lost("discount_man", threshold),
        "reduction": fixed & lost("discount_jian", reduction),
        # The rate of a fixed reduction is rounded, so it may well be 0.
        "rate": (plain & lost(eq_rate, F.col(c).try_cast("double"))) | (fixed & (threshold > 0) & F.col(eq_rate).isNull()),
    }


def discount_overflow(df: DataFrame, c: str = "discount_rate", eq_rate: str = "discount_eq_rate") -> DataFrame:
    """Parsed discounts that do not fit the declared decimals, with their row count.

    Such an amount is NULL or 0 in its column; ``field`` says which one it was, so
    that none disappears uncounted.
    """
    fields = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in discount_losses(c, eq_rate).items()]))
    return df.select(F.explode(fields).alias("field")).groupBy("field").agg(F.count("*").alias("row_count"))


def invalid_values(df: DataFrame, c: str = "discount_type", allowed: tuple[str, ...] = DISCOUNT_TYPES) -> DataFrame:
    """Values outside the declared list, with their row count."""
    return df.where(~F.col(c).isin(*allowed)).groupBy(c).agg(F.count("*").alias("row_count"))
