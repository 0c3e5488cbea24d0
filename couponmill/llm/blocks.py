"""All pairs inside groups without one large task: groups dealt to bounded blocks.

A group is cut into chunks by a hash of its members, and each pair of chunks is
a block of its own.  Blocks return counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK_SCHEMA = "node long, n_links long, root long"


def in_blocks(members: DataFrame, group: str, chunks: str, carry: list[str]) -> DataFrame:
    """Each row once for every block its chunk takes part in, sorted by block.

    ``chunks`` is the number of chunks of the row's group.  Adds ``lo`` and
    ``hi``, the chunks of the block, and ``side``, the chunk of the row.
    """
    side = F.pmod(F.xxhash64("node"), F.col(chunks)).alias("side")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1)).alias("_other")
    return (
        members.select(group, chunks, "node", *carry, side)
        .select("*", other)
        .select(
            group,
            F.least("side", "_other").alias("lo"),
            F.greatest("side", "_other").alias("hi"),
            "side",
            "node",
            *carry,
        )
        .repartition(group, "lo", "hi")
        .sortWithinPartitions(group, "lo", "hi")
    )


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal integer keys in sorted batches, and the rows where runs begin."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for key in keys:
            value = table.column(key).to_numpy()
            change[1:] |= value[1:] != value[:-1]
        starts = np.flatnonzero(change)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal integer keys in sorted batches."""
    for table, starts in whole_runs(batches, keys):
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            yield table.slice(a, b - a)


def pairs_within(starts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs inside the runs that begin at ``starts``."""
    ends = np.append(starts[1:], rows)
    count = np.repeat(ends, ends - starts) - np.arange(rows) - 1
    a = np.repeat(np.arange(rows), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
    return a, b


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block's two chunks; the same rows twice if it has one."""
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    if lo == hi:
        rows = np.arange(table.num_rows)
        return rows, rows
    side = table.column("side").to_numpy()
    return np.flatnonzero(side == lo), np.flatnonzero(side == hi)


def forest(nodes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest node that each node reaches over the pairs of row numbers."""
    a, b = pairs
    label = nodes.copy()
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    return label
