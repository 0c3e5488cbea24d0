"""Near-duplicate texts by n-gram Jaccard similarity with a MinHash LSH forest.

1. Every text is reduced to its set of word n-grams and a signature: one label
   of ``depth`` minimum hashes for each of ``trees`` sorted prefix tries.
   Texts with the same set form a class; only one of each class goes on.
2. The labels of a trie are sorted, so that classes with long common prefixes
   stand together.  Classes are joined to clusters from the longest prefixes
   on, if their signatures are not far from similar.  Prefixes are shortened only
   where a trie node still holds several clusters, and only classes of
   different clusters are compared there, until the prefix at which
   a pair at the threshold is found with the target recall.
3. The n-gram sets of the clusters are compared exactly, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.llm.blocks import LINK_SCHEMA, forest, in_blocks, runs, sides, whole_runs
from couponmill.llm.components import components
from couponmill.llm.shipping import ship
from couponmill.llm.words import ngrams, slices, utf8, words
from couponmill.operators.ordering import sized_broadcast
from couponmill.session import Scratch, stage


# Cluster members, of 40 bytes each, that are broadcast to the texts at most.
MEMBERS_BROADCAST = 200_000


@dataclass(frozen=True)
class Forest:
    """Parameters of the join."""

    ngram: int = 5
    threshold: float = 0.8
    trees: int = 20
    depth: int = 6
    recall: float = 0.999
    block_rows: int = 512
    block_ngrams: int = 1_000_000

    @property
    def prefix(self) -> int:
        """Where shortening ends: the longest prefix that finds a pair at the threshold with the target recall."""
        for k in range(self.depth, 0, -1):
            if 1 - (1 - self.threshold**k) ** self.trees >= self.recall:
                return k
        raise ValueError("the target recall needs more trees")

    @property
    def floor(self) -> float:
        """Share of equal minimum hashes below which a pair cannot reach the threshold.

        More than five standard deviations under the expectation at the threshold.
        """
        hashes = self.trees * self.depth
        return self.threshold - 5.5 * (self.threshold * (1 - self.threshold) / hashes) ** 0.5


def sketch(run: np.ndarray, index: np.ndarray, p: Forest) -> np.ndarray:
    """Signatures, one row of ``trees * depth`` minimum hashes per text that has n-grams."""
    random = np.random.default_rng(7)
    hashes = p.trees * p.depth
    odd = random.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = random.integers(0, 1 << 63, hashes, dtype=np.uint64)
    begins = index[:-1][np.diff(index) > 0]
    out = np.empty((len(begins), hashes), np.uint32)
    edge = [0]
    # Some texts at a time, so that the hashed n-grams stay in the cache.
    while edge[-1] < len(begins):
        goal = begins[edge[-1]] + 32_768
        edge.append(max(int(np.searchsorted(begins, goal)), edge[-1] + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        end = begins[b] if b < len(begins) else len(run)
        part, at = run[begins[a] : end], begins[a:b] - begins[a]
        work = np.empty_like(part)
        for j in range(hashes):
            np.bitwise_xor(part, flip[j], out=work)
            np.multiply(work, odd[j], out=work)
            out[a:b, j] = np.minimum.reduceat(work, at) >> np.uint64(32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _marks(docs: DataFrame, id_col: str, text: str, p: Forest) -> DataFrame:
    """Set key, size and signature of every text that has words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values, index = ngrams(*words(*utf8(part.column(text))), p.ngram)
                has = np.flatnonzero(np.diff(index))
                sets = [np.unique(values[index[i] : index[i + 1]]) for i in has]
                signature = sketch(values, index, p)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col).take(pa.array(has)),
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _binary(signature),
                    ],
                    names=[id_col, "set_key", "size", "signature"],
                )

    schema = f"`{id_col}` {kind}, set_key binary, size long, signature binary"
    return docs.select(id_col, text).mapInArrow(run, schema)


def _signatures(table: pa.Table) -> np.ndarray:
    flat = b"".join(table.column("signature").to_pylist())
    return np.frombuffer(flat, np.uint32).reshape(table.num_rows, -1)


def climb(signature: np.ndarray, trie: np.ndarray, starts: np.ndarray, p: Forest) -> np.ndarray:
    """First row of the cluster of each row, for sorted pieces of tries that begin at ``starts``.

    Starts at the full labels and shortens them hash by hash.  At each length,
    neighbours are compared first; then, in the trie nodes that still hold several
    clusters, all rows of different clusters.
    """
    rows = len(signature)
    at = trie[:, None] * p.depth + np.arange(p.depth)
    labels = np.take_along_axis(signature, at, axis=1)
    common = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    common[starts[1:] - 1] = -1
    root = np.arange(rows)
    for length in range(p.depth, p.prefix - 1, -1):
        a = np.flatnonzero((common == length) & (root[1:] != root[:-1]))
        a = a[(signature[a] == signature[a + 1]).mean(axis=1) >= p.floor]
        both = np.concatenate([a, np.arange(rows)]), np.concatenate([a + 1, root])
        root = forest(np.arange(rows), both)
        begins = np.flatnonzero(np.append(True, common < length))
        ends = np.append(begins[1:], rows)
        several = np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)
        # Two rows are neighbours.
        for i, j in zip(begins[several & (ends - begins > 2)], ends[several & (ends - begins > 2)]):
            _join_clusters(signature[i:j], root[i:j], p)
    return root


def _join_clusters(signature: np.ndarray, root: np.ndarray, p: Forest) -> None:
    """Join the clusters of one trie node in place; rows of its largest cluster are only compared with others."""
    names, counts = np.unique(root, return_counts=True)
    for i in np.flatnonzero(root != names[np.argmax(counts)]):
        others = np.flatnonzero(root != root[i])
        close = others[(signature[others] == signature[i]).mean(axis=1) >= p.floor]
        if len(close):
            joined = np.append(np.unique(root[close]), root[i])
            root[np.isin(root, joined)] = joined.min()


def _candidates(classes: DataFrame, p: Forest, work: Scratch) -> DataFrame:
    """``node`` and ``root`` of the clusters of classes with close signatures and a common label prefix in some trie.

    A trie node of more than ``block_rows`` classes is climbed in pieces, dealt anew
    in every trie; what is left of it in several clusters is compared in blocks.
    """
    trie = F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))).alias("trie")
    first = F.col("trie") * (4 * p.depth) + 1
    prefix = F.substring("signature", first, F.lit(4 * p.prefix))
    labels = classes.select("node", "signature", trie).select("node", "trie", F.xxhash64("trie", prefix).alias("bucket"))
    shared = work.stage(labels.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1"))
    pieces = F.ceil(F.col("_n") / p.block_rows).cast("long")
    members = labels.join(shared, "bucket")
    dealt = (
        members.withColumn("part", F.pmod(F.xxhash64("node", "trie"), pieces))
        .join(classes.select("node", "signature"), "node")
        .repartition("bucket", "part")
        .sortWithinPartitions("bucket", "part", F.substring("signature", first, F.lit(4 * p.depth)), "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["bucket", "part"]):
            nodes = table.column("node").to_numpy()
            root = climb(_signatures(table), table.column("trie").to_numpy(), starts, p)
            linked = nodes[root] != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], names=["a", "b"])

    links = work.stage(dealt.select("bucket", "part", "node", "trie", "signature").mapInArrow(run, "a long, b long"))
    clusters = work.stage(components(links, work.stage))
    if shared.where(F.col("_n") > p.block_rows).isEmpty():
        return clusters
    large = members.where(F.col("_n") > p.block_rows).select("node", "bucket")
    # Only clusters are joined there, so the links inside them need no second round.
    upper = work.stage(components(_between(classes, large, clusters, p, work), work.stage))
    upper = sized_broadcast(upper.select(F.col("node").alias("_lower"), F.col("root").alias("_upper")))
    joined = clusters.join(upper, F.col("root") == F.col("_lower"), "left").select("node", F.coalesce("_upper", "root").alias("root"))
    alone = upper.join(sized_broadcast(clusters.select("node")), F.col("_lower") == F.col("node"), "left_anti")
    return work.stage(joined.union(alone.select("_lower", "_upper")))


def _between(classes: DataFrame, large: DataFrame, clusters: DataFrame, p: Forest, work: Scratch) -> DataFrame:
    """Links between clusters that share a large trie node.

    Rows of a node's largest cluster are together already: they meet the
    other rows, never each other.
    """
    placed = work.stage(large.join(clusters, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tally = placed.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
    tally = tally.groupBy("bucket").agg(F.max(F.struct("_n", "root")).alias("_most"), F.sum("_n").alias("_all"))
    tally = tally.select("bucket", F.col("_most.root").alias("_most"), "_all", (F.col("_all") - F.col("_most._n")).alias("_rest"))
    rows = placed.join(tally.where("_rest > 0"), "bucket").join(classes.select("node", "signature"), "node")
    blocks = [F.ceil(F.col(c) / p.block_rows).cast("long") for c in ("_rest", "_all")]
    own = [F.pmod(F.xxhash64("node"), n) for n in blocks]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), n - 1)) for n in blocks]
    carry = ["bucket", "root", "signature"]
    left = rows.where("root <> _most").select(*carry, own[0].alias("lo"), every[1].alias("hi"), F.lit(0).alias("side"))
    right = rows.select(*carry, every[0].alias("lo"), own[1].alias("hi"), F.lit(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["bucket", "lo", "hi"]):
            signature, root = _signatures(block), block.column("root").to_numpy()
            side = block.column("side").to_numpy()
            high = np.flatnonzero(side == 1)
            pairs = [np.zeros((2, 0), np.int64)]
            for i in np.flatnonzero(side == 0):
                others = high[root[high] != root[i]]
                close = np.unique(root[others[(signature[others] == signature[i]).mean(axis=1) >= p.floor]])
                pairs.append(np.stack([np.full(len(close), root[i]), close]))
            a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = left.union(right).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return work.stage(dealt.mapInArrow(run, "a long, b long"))


def shared_counts(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Number of common elements of each set in ``low`` with each in ``high``."""
    if len(low) == 2 and low is high:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, n], [n, 0]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    owner, column = owner[common[column]], number[column[common[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(low), len(high)), np.int64)
    width = 8192
    for at in range(0, int(number[-1]) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        there = np.zeros((len(sets), width), np.float32)
        there[owner[a:b], column[a:b] - at] = 1
        total += np.rint(there[low] @ there[high].T).astype(np.int64)
    return total


def _exact(
    classes: DataFrame, docs: DataFrame, id_col: str, text: str, clusters: DataFrame, p: Forest, work: Scratch
) -> DataFrame:
    """Link counts and block-wise spanning forests of exactly similar classes."""
    member = clusters.join(classes.select("node", "first_id", "size", "copies"), "node")
    chunks = F.greatest(F.ceil(F.col("_n") / p.block_rows), F.ceil(F.col("_size") / p.block_ngrams)).cast("long")
    sizes = member.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    sizes = sized_broadcast(work.stage(sizes.select("cluster", chunks.alias("_chunks"))))
    member = member.join(sizes, F.col("root") == F.col("cluster"))
    member = member.select("node", "cluster", "_chunks", "copies", F.col("first_id").alias(id_col))
    # A few numbers per class; many of them are joined by shuffle.
    texts = docs.select(id_col, text).join(sized_broadcast(work.stage(member), MEMBERS_BROADCAST), id_col)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values, index = ngrams(*words(*utf8(part.column(text))), p.ngram)
                sets = [np.unique(values[a:b]).tobytes() for a, b in zip(index[:-1], index[1:])]
                names = ["node", "cluster", "_chunks", "copies"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(sets, pa.binary())], names=[*names, "ngrams"])

    sets = texts.mapInArrow(to_sets, "node long, cluster long, _chunks long, copies long, ngrams binary")
    share = Fraction(p.threshold).limit_denominator(1000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["cluster", "lo", "hi"]):
            nodes, copies = block.column("node").to_numpy(), block.column("copies").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in block.column("ngrams").to_pylist()]
            low, high = sides(block)
            if not len(low) or not len(high):
                continue
            size = np.array([len(s) for s in sets], np.int64)
            both = shared_counts(sets, low, high)
            either = size[low][:, None] + size[high][None, :] - both
            linked = both * share.denominator >= either * share.numerator
            if low is high:
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, low[a], copies[high[b]])
            if low is not high:
                np.add.at(links, high[b], copies[low[a]])
            root = forest(nodes, (low[a], high[b]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(root)], names=["node", "n_links", "root"])

    return in_blocks(sets, "cluster", "_chunks", ["copies", "ngrams"]).mapInArrow(compare, LINK_SCHEMA)


def _placed(docs: DataFrame, row: str, text: str, p: Forest) -> DataFrame:
    """``row``, ``root``, ``n_links`` and ``n_copies`` of every document of a stored table with unique ``row``.

    All that is written on the way is removed again.
    """
    work = Scratch(docs.sparkSession)
    marks = work.stage(_marks(docs, row, text, p))
    classes = marks.groupBy("set_key").agg(
        F.min(row).alias("first_id"),
        F.count("*").alias("copies"),
        *[F.any_value(c).alias(c) for c in ("size", "signature")],
    )
    classes = work.stage(classes.withColumn("node", F.monotonically_increasing_id()))
    clusters = _candidates(classes, p, work)
    exact = work.stage(_exact(classes, docs, row, text, clusters, p, work))
    roots = components(exact.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")), work.stage)
    links = exact.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    placed = (
        classes.select("set_key", "node", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select(
            "set_key",
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            (F.col("copies") - 1).alias("n_copies"),
        )
    )
    rows = stage(marks.select(row, "set_key").join(placed, "set_key").drop("set_key"))
    work.remove()
    return rows


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: Forest = Forest()) -> DataFrame:
    """One row per document: ``id_col``, ``class_id``, ``n_links`` and ``n_copies``.

    ``n_links`` counts the other documents whose n-gram sets have a Jaccard
    similarity of at least ``threshold``; ``n_copies`` those among them with the
    same set.  ``class_id`` is the smallest id reachable over links.  Texts of
    fewer words than an n-gram have one n-gram of all words; texts without words
    (NULL, empty) have no similarity to anything and are a class of their own.
    Ids that repeat or are NULL are compared by their texts like any other; a
    class without any id has the class id NULL.  An empty table gives an
    empty table.
    """
    ship(docs.sparkSession)
    docs = stage(docs.select(F.col(id_col), F.col(text), F.monotonically_increasing_id().alias("_row")))
    rows = docs.select("_row", id_col).join(_placed(docs, "_row", text, p), "_row", "left")
    smallest = stage(rows.where("root IS NOT NULL").groupBy("root").agg(F.min(id_col).alias("class_id")))
    return rows.join(sized_broadcast(smallest), "root", "left").select(
        id_col,
        F.when(F.col("root").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )


def deduplicate(docs: DataFrame, text: str = "text", p: Forest = Forest()) -> DataFrame:
    """One document of each class, the first in the order of the input files."""
    row = "_document_row"
    ship(docs.sparkSession)
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = _placed(numbered, row, text, p).select(row, "root")
    first = stage(rows.groupBy("root").agg(F.min(row).alias("_first")))
    others = stage(rows.join(sized_broadcast(first), "root").where(F.col(row) > F.col("_first")).select(row))
    return numbered.join(sized_broadcast(others), row, "left_anti").drop(row)


OP8_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT a, b, common.n = x.n AND common.n = y.n AS same
    FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 5 * common.n >= 4 * (x.n + y.n - common.n)
),
reach AS (
    SELECT a AS doc_id, b AS other FROM links
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
),
roots AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS n_copies FROM links GROUP BY 1)
SELECT w.doc_id, least(w.doc_id, coalesce(other, w.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies
FROM w LEFT JOIN roots ON w.doc_id = roots.doc_id LEFT JOIN counts ON w.doc_id = counts.doc_id
"""
