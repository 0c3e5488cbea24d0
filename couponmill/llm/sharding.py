"""Sharding with a hierarchical weighted hash tree.

A key descends from the root over region and rack to a shard.  At every level
each child draws ``ln(u) / weight`` with ``u`` a hash of the key and the child's
name, and the largest draw wins, so children get shares by weight and a change of
weights below one child moves keys only into or out of that subtree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponmill.operators.ordering import with_row_id
from couponmill.session import stage

RACKS, SHARDS_PER_RACK = 2, 4
BASE_SHARDS = 16


@dataclass(frozen=True)
class Node:
    """A region, a rack, or a shard (which has a number and no children)."""

    name: str
    own_weight: float = 0.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return self.own_weight + sum(c.weight for c in self.children)


def layout(shards: int, base: int = BASE_SHARDS) -> Node:
    """The tree of ``shards`` shards of equal weight.

    The first ``base`` fill regions of RACKS racks of SHARDS_PER_RACK shards.
    Each later shard is a region of its own: the weights of all other subtrees
    stay as they are, so it takes keys only into itself.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    racks: dict[tuple[int, int], list[Node]] = {}
    for s in range(min(shards, base)):
        rack = s // SHARDS_PER_RACK
        racks.setdefault((rack // RACKS, rack % RACKS), []).append(Node(f"shard{s}", 1.0, s))
    regions: dict[int, list[Node]] = {}
    for (region, rack), members in racks.items():
        regions.setdefault(region, []).append(Node(f"region{region}/rack{rack}", children=tuple(members)))
    top = [Node(f"region{r}", children=tuple(members)) for r, members in regions.items()]
    for s in range(base, shards):
        top.append(Node(f"grown{s}", children=(Node(f"grown{s}/rack0", children=(Node(f"shard{s}", 1.0, s),)),)))
    return Node("root", children=tuple(top))


def draw(key: Column, node: Node) -> Column:
    """Weighted draw of a key for a node, at most zero; never for a node without weight."""
    if node.weight <= 0:
        return F.lit(float("-inf"))
    number = F.pmod(F.xxhash64(key, F.lit(node.name)), F.lit(1 << 52)).cast("double")
    return F.log((number + 0.5) / float(1 << 52)) / node.weight


def descend(key: Column, node: Node) -> Column:
    """Shard number of a key below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [draw(key, child) for child in node.children]
    best = F.greatest(*draws)
    chosen = descend(key, node.children[-1])
    for value, child in list(zip(draws, node.children))[-2::-1]:
        chosen = F.when(value == best, descend(key, child)).otherwise(chosen)
    return chosen


def assign(df: DataFrame, key: str, tree: Node, out: str = "shard") -> DataFrame:
    """Add the shard of each row's key; rows without a key have one shard together."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumn(out, descend(text, tree).cast("int"))


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = BASE_SHARDS) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    The law is ``key``: the key and the number of shards decide, so rows of
    one key share a shard.  ``size`` is the UTF-8 length plus 1 (NULL text: 1)
    and ``grown_shard`` the shard among one more.  ``slot`` numbers a shard's
    rows without gaps from 0 by key, size and checksum; rows equal in these
    are numbered in any order.  NULL keys share a shard; an empty table stays
    empty; other columns are not read.
    """
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        key,
        (F.octet_length(bytes_of) + F.lit(1)).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
    )
    rows = assign(assign(rows, key, layout(shards)), key, layout(shards + 1), "grown_shard")
    numbered = stage(with_row_id(rows, ["shard", key, "size", "text_crc32"], "_number"))
    # One row per shard.
    first = numbered.groupBy("shard").agg(F.min("_number").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_number") - F.col("_first")).alias("slot"), "grown_shard"
    )
