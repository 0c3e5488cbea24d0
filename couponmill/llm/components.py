"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.session import BROADCAST_ROWS, stage


def components(links: DataFrame, put: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for links ``a``, ``b`` of long ids.

    Large-star and small-star steps alternate until every node is linked to its root
    alone; a node's neighbours are never gathered, only their minimum is.  The minima of
    few links are broadcast, those of many joined by shuffle.  Every step is
    written by ``put``, into the checkpoint folder.  Nodes without a link have no row.
    """
    links = put(_ordered(links.where("a <> b")))
    while not _settled(links):
        small = 2 * links.count() <= BROADCAST_ROWS
        links = put(_small_star(_large_star(links, small), small))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select("b", F.col("b").alias("root")).distinct()
    )


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link at most, and none that others are linked to has its own."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("others")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("others").alias("others"))
    return ends.where("own > 1 OR own + others > 1").isEmpty()


def _joined(links: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    return links.join(F.broadcast(least) if small else least, "a")


def _large_star(links: DataFrame, small: bool) -> DataFrame:
    """Link the larger neighbours of every node to the smallest one; links may repeat."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return _joined(both.where("b > a"), least, small).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame, small: bool) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    others = _joined(links, least, small).where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.union(least).distinct()
