"""Searches that visit buckets of an index: entries and searches meet in bounded blocks.

An index deals its entries to numbered buckets (cells, leaves).  Small buckets
that follow each other share a block, a large one is dealt to several.  A search
is sent once to every block that holds a bucket it visits, and blocks that very
many searches visit are cut along the searches too.  So neither a hot bucket
nor a hot neighbourhood is a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponmill.llm.blocks import runs
from couponmill.operators.ordering import sized_broadcast
from couponmill.session import pin

# Entries of a block, about.
BLOCK_ROWS = 4_096
# Searches of a block, about; more of them are dealt to several copies of the block.
BLOCK_SEARCHES = 16_384


@dataclass(frozen=True)
class Layout:
    """First block and number of blocks of every bucket."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, block_rows: int = BLOCK_ROWS) -> Layout:
        """Blocks of about ``block_rows`` entries for buckets of so many entries each."""
        first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        block, filled = 0, 0
        for bucket, n in enumerate(counts.tolist()):
            if filled and filled + n > block_rows:
                block, filled = block + 1, 0
            first[bucket], parts[bucket] = block, max(1, -(-n // block_rows))
            filled += n
            if n > block_rows:
                block, filled = block + int(parts[bucket]), 0
        return cls(first, parts)

    def block_of(self, bucket: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Block of entries with the given bucket; ``number`` deals those of a large bucket."""
        spread = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[bucket] + (spread % self.parts[bucket].astype(np.uint64)).astype(np.int64)

    def blocks_of(self, buckets: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The blocks that hold the buckets, each with those of the buckets it holds."""
        buckets = np.sort(buckets)
        parts = self.parts[buckets]
        bucket = np.repeat(buckets, parts)
        within = np.arange(len(bucket)) - np.repeat(np.cumsum(parts) - parts, parts)
        block = self.first[bucket] + within
        order = np.argsort(block, kind="stable")
        block, bucket = block[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        return [(int(block[a]), bucket[a:b]) for a, b in zip(starts, np.append(starts[1:], len(block)))]


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column without NULLs; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def per_bucket(block: pa.Table, searches: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every bucket of a block that is visited: row numbers of its entries and of its searches."""
    bucket = block.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    wanted = searches.column("buckets").combine_chunks()
    asked = wanted.flatten().to_numpy()
    who = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
    by = np.argsort(asked, kind="stable")
    asked, who = asked[by], who[by]
    for b in np.unique(asked):
        low, high = np.searchsorted(bucket[order], [b, b + 1])
        left, right = np.searchsorted(asked, [b, b + 1])
        if high > low:
            yield order[low:high], who[left:right]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """True at the ``k`` largest numbers of every row and at all that equal the last of them."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return scores >= last[:, None]


def meet(
    entries: DataFrame,
    searches: DataFrame,
    compare: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]],
    schema: str,
    block_searches: int = BLOCK_SEARCHES,
) -> DataFrame:
    """What ``compare`` makes of every block's entries and searches.

    Both frames have a column ``block``, ``entries`` also ``bucket`` and
    ``searches`` the ``search`` they are dealt by and ``buckets``; other columns
    are theirs.  ``searches`` is read twice and should be staged.
    """
    sizes = searches.groupBy("block").agg(F.ceil(F.count("*") / block_searches).cast("long").alias("_parts"))
    sizes = sized_broadcast(pin(sizes))
    last = F.col("_parts") - 1
    held = entries.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    asked = searches.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("search"), F.col("_parts")))
    both = held.drop("_parts").withColumn("asks", F.lit(False)).unionByName(
        asked.drop("_parts").withColumn("asks", F.lit(True)), allowMissingColumns=True
    )
    own, theirs = entries.columns, searches.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["block", "part"]):
            asks = block.column("asks").to_numpy()
            here, there = block.filter(pa.array(~asks)).select(own), block.filter(pa.array(asks)).select(theirs)
            if here.num_rows and there.num_rows:
                yield from compare(here, there)

    return both.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(run, schema)


def first_per(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group, cut down in each task before the shuffle too."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_n") <= k).drop("_n")


def equal_vectors(rows: DataFrame, group: list[str], id_col: str, k: int) -> DataFrame:
    """One row per value of ``group`` with its ``k`` smallest ids in ``ids``; repeated rows count once."""
    distinct = rows.select(*group, id_col).distinct()
    few = first_per(distinct, group, [F.col(id_col)], k)
    return few.groupBy(*group).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
