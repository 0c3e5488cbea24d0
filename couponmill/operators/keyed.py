"""Joins of the fact with a set of keys, safe for hot and NULL keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.session import BROADCAST_ROWS


def hot_keys(f: DataFrame, key: str, parts: int) -> list:
    """Keys with more rows than an even share of ``parts``; there are fewer than ``parts`` of them."""
    counted = f.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return [row[0] for row in counted.where(F.col("_n") > f.count() / parts).select(key).collect()]


def keyed_join(f: DataFrame, dim: DataFrame, key: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``f`` with the distinct keys of ``dim``; ``left`` adds the flag ``_known``.

    Up to ``limit`` keys are broadcast and the fact stays where it is.  More
    keys are joined by shuffle.  Keys that hold more than one shuffle
    partition's share of the fact, and rows without a key, get a salt with as
    many values as there are partitions; only these keys are repeated.
    ``dim`` is counted here, so it should be a stored or pinned table.
    """
    known = dim.select(key).distinct().withColumn("_known", F.lit(True))
    if known.count() <= limit:
        joined = f.join(F.broadcast(known), key, how)
    else:
        parts = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = hot_keys(f, key, parts)
        is_hot = F.col(key).isin(hot) if hot else F.lit(False)
        # Content and partition number do not change when a task is run again; copies of one row are spread too.
        spread = F.pmod(F.xxhash64(*f.columns) + F.spark_partition_id(), F.lit(parts)).cast("int")
        salted = f.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, spread).otherwise(0))
        last = F.when(is_hot, parts - 1).otherwise(0)
        copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        joined = salted.join(copies, [key, "_salt"], how)
    return joined.select(*f.columns, *(["_known"] if how == "left" else []))
