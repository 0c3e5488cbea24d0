"""Hard negatives with a multiway hyperplane tree that stores distance ranges.

Every inner node has several split points, and a row belongs to the child of the
one it is nearest to.  For each pair of split point and sibling subtree the tree
stores the least and the greatest distance from the point to the subtree's rows.
A search knows its own distances to the split points, so by the triangle
inequality each range bounds its distance to the subtree; a subtree whose
bounds miss the annulus of the wanted scores is left out.  Leaves that remain
are compared exactly, in integers.

A score window becomes an annulus because all rows get one more component that
brings them to the same length and is 0 for searches: then the squared distance is
a constant minus twice the inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponmill.llm.shipping import ship
from couponmill.llm.visits import Layout, best, equal_vectors, first_per, matrix, meet, per_bucket
from couponmill.llm.words import mix
from couponmill.session import Scratch

# Products of whole numbers below this are exact in double precision.
EXACT = 2.0**53
# Lower and upper limit of an open window.
LEAST, GREATEST = -(1 << 62), 1 << 62
# Scaled components below 2 to this power keep scores, times a hundred, within 64 bits for a thousand components.
LARGEST_BITS = 23


@dataclass(frozen=True)
class Mining:
    """Parameters of the search and of its tree."""

    positives: int = 5
    negatives: int = 10
    # A negative's score lies between these hundredths of the positive's.
    least_percent: int = 30
    most_percent: int = 90
    # Components are multiplied by this and rounded down.
    scale: int = 256
    ways: int = 16
    leaf_rows: int = 200
    depth: int = 4
    # Split points are chosen from about this many rows, or fewer of so many numbers in all.
    sample_rows: int = 16_384
    sample_numbers: int = 4_000_000
    seed: int = 23


@dataclass
class Node:
    """Split points of one inner node; a child is an inner node or minus one minus its leaf."""

    points: np.ndarray
    extra: np.ndarray
    children: list[int]
    #: point x child: least and greatest distance from the point to the child's rows
    nearest: np.ndarray = field(default=None)
    farthest: np.ndarray = field(default=None)


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    #: the squared length to which all rows are brought
    length: float

    def extra(self, x: np.ndarray) -> np.ndarray:
        """The additional component of rows."""
        return np.sqrt(np.maximum(self.length - (x**2).sum(axis=1), 0))

    def distances(self, node: Node, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of rows (or, with an additional component of 0, of searches) to the split points."""
        squared = ((x**2).sum(axis=1) + extra**2)[:, None] + self.length
        return np.sqrt(np.maximum(squared - 2 * (x @ node.points.T + extra[:, None] * node.extra), 0))

    def descend(self, x: np.ndarray, extra: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Every inner node that rows pass: its number, their row numbers, distances and children."""
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            number, rows = open_nodes.pop()
            node = self.nodes[number]
            distance = self.distances(node, x[rows], extra[rows])
            child = distance.argmin(axis=1)
            yield number, rows, distance, child
            for j, below in enumerate(node.children):
                if below >= 0 and (child == j).any():
                    open_nodes.append((below, rows[child == j]))

    def leaf(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        for number, rows, _, child in self.descend(x, extra):
            below = np.array(self.nodes[number].children)[child]
            out[rows[below < 0]] = -1 - below[below < 0]
        return out

    def reached(self, x: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """True for each search and leaf unless no row of the leaf lies between ``near`` and ``far`` (row x window)."""
        out = np.zeros((len(x), self.leaves), bool)
        open_nodes = [(0, np.arange(len(x)), np.zeros(len(x)), np.full(len(x), np.inf))]
        while open_nodes:
            number, rows, least, most = open_nodes.pop()
            node = self.nodes[number]
            distance = self.distances(node, x[rows], np.zeros(len(rows)))
            # A hair wider, so that rounding leaves out nothing.
            slack = 1e-9 * (np.sqrt(self.length) + distance.max(axis=1, initial=0)) + 1e-9
            for j, below in enumerate(node.children):
                if not np.isfinite(node.farthest[0, j]):
                    continue
                low = np.maximum(least, np.maximum(distance - node.farthest[:, j], node.nearest[:, j] - distance).max(axis=1))
                high = np.minimum(most, (distance + node.farthest[:, j]).min(axis=1))
                meets = ((near[rows] <= (high + slack)[:, None]) & (far[rows] >= (low - slack)[:, None])).any(axis=1)
                if not meets.any():
                    continue
                if below < 0:
                    out[rows[meets], -1 - below] = True
                else:
                    open_nodes.append((below, rows[meets], low[meets], high[meets]))
        return out


def plant(x: np.ndarray, length: float, p: Mining, rows: int) -> Tree:
    """A tree over a sample of ``rows`` rows; the split points of a node are far from each other."""
    random = np.random.default_rng(p.seed)
    tree = Tree([], 0, length)
    extra = tree.extra(x)
    # Rows of the table that a row of the sample stands for.
    weight = rows / max(len(x), 1)

    def grow(at: np.ndarray, depth: int) -> int:
        ways = min(p.ways, max(2, int(len(at) * weight / p.leaf_rows) + 1))
        if depth and (depth >= p.depth or len(at) * weight <= p.leaf_rows or len(at) < 2 * ways):
            tree.leaves += 1
            return -tree.leaves
        some = at[random.permutation(len(at))[: 3 * ways]]
        full = np.column_stack([x[some], extra[some]])
        chosen = [0]
        far = ((full - full[0]) ** 2).sum(axis=1)
        while len(chosen) < min(ways, len(some)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
        node = Node(x[some[chosen]], extra[some[chosen]], [])
        number = len(tree.nodes)
        tree.nodes.append(node)
        child = tree.distances(node, x[at], extra[at]).argmin(axis=1)
        for j in range(len(chosen)):
            below = at[child == j]
            if len(chosen) > 1:
                node.children.append(grow(below, depth + 1))
            else:
                tree.leaves += 1
                node.children.append(-tree.leaves)
        return number

    if not len(x):
        x, extra = np.zeros((1, x.shape[1])), np.full(1, np.sqrt(length))
    grow(np.arange(len(x)), 0)
    return tree


def with_ranges(tree: Tree, rows: DataFrame, vector: str) -> Tree:
    """Measure the ranges over all rows: one pass, and as many numbers as the tree has pairs of point and child."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        least = {n: np.full((len(node.points), len(node.children)), np.inf) for n, node in enumerate(t.nodes)}
        most = {n: np.full_like(a, -np.inf) for n, a in least.items()}
        for batch in batches:
            x = matrix(batch.column(vector))
            for number, _, distance, child in t.descend(x, t.extra(x)):
                np.minimum.at(least[number].T, child, distance)
                np.maximum.at(most[number].T, child, distance)
        for number in least:
            i, j = np.nonzero(np.isfinite(least[number]))
            columns = [np.full(len(i), number), i, j, least[number][i, j], most[number][i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "i", "j", "least", "most"])

    parts = rows.select(vector).mapInArrow(measure, "node long, i long, j long, least double, most double")
    for node in tree.nodes:
        node.nearest = np.full((len(node.points), len(node.children)), np.inf)
        node.farthest = np.full_like(node.nearest, np.inf)
    for r in parts.groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
        node = tree.nodes[r["node"]]
        node.nearest[r["i"], r["j"]], node.farthest[r["i"], r["j"]] = r["least"], r["most"]
    return tree


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < EXACT:
        return np.rint(x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def annulus(length: float, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances at which rows have scores of ``low`` to ``high``; an empty window gets none."""
    square = (x**2).sum(axis=1)[:, None] + length
    near, far = (np.sqrt(np.maximum(square - 2 * s.astype(np.float64), 0)) for s in (high, low))
    return np.where(low > high, np.inf, near), np.where(low > high, -np.inf, far)


def _candidates(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (search, entry) of the ``k`` best allowed scores and of their ties."""
    masked = np.where(allowed, score, np.int64(LEAST))
    return np.nonzero(best(masked, k) & allowed)


@dataclass
class Index:
    """What a search needs on every worker."""

    tree: Tree
    layout: Layout


FOUND = "search long, label long, slot int, score long, id long"


def _visits(asked: DataFrame, index, home: bool, dim_type: str) -> DataFrame:
    """A row for every search and block it visits: its home leaf, or all other leaves that its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, layout = index.value.tree, index.value.layout
        names = ["search", "label", "w", "low", "high"]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = matrix(part.column("w"))
                own = tree.leaf(x, np.zeros(len(x)))
                low, high = matrix(part.column("low"), np.int64), matrix(part.column("high"), np.int64)
                if home:
                    leaves = [np.array([n]) if (a <= b).any() else np.zeros(0, np.int64) for n, a, b in zip(own, low, high)]
                else:
                    reached = tree.reached(x, *annulus(tree.length, x, low, high))
                    reached[np.arange(len(x)), own] = False
                    leaves = [np.flatnonzero(r) for r in reached]
                visits = [(i, block, buckets) for i, n in enumerate(leaves) for block, buckets in layout.blocks_of(n)]
                at = pa.array([i for i, _, _ in visits], pa.int64())
                columns = [pa.array([b for _, b, _ in visits], pa.int64())]
                columns.append(pa.array([b.tolist() for _, _, b in visits], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(part.column(n).take(at) for n in names)], names=["block", "buckets", *names]
                )

    schema = f"block long, buckets array<long>, search long, label long, w {dim_type}, low array<long>, high array<long>"
    return asked.select("search", "label", "w", "low", "high").mapInArrow(run, schema)


def _exact(entries: DataFrame, visits: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of every search and window in every block."""

    def compare(block: pa.Table, here: pa.Table) -> Iterator[pa.RecordBatch]:
        x, q = matrix(block.column("v"), np.int64), matrix(here.column("w"), np.int64)
        labels, wanted = block.column("entry_label").to_numpy(), here.column("label").to_numpy()
        low, high = matrix(here.column("low"), np.int64), matrix(here.column("high"), np.int64)
        ids = block.column("ids").combine_chunks()
        size, value = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
        first = np.cumsum(size) - size
        parts = []
        for rows, who in per_bucket(block, here):
            score = products(q[who], x[rows])
            agrees = (wanted[who][:, None] == labels[rows]) == same
            for slot in range(low.shape[1]):
                allowed = agrees & (score >= low[who, slot][:, None]) & (score <= high[who, slot][:, None])
                a, b = _candidates(score, allowed, k)
                parts.append((who[a], np.full(len(a), slot), score[a, b], rows[b]))
        if not parts:
            return
        who, slot, score, row = (np.concatenate(z) for z in zip(*parts))
        at = np.repeat(first[row] - np.cumsum(size[row]) + size[row], size[row]) + np.arange(size[row].sum())
        who, slot, score = (np.repeat(z, size[row]) for z in (who, slot, score))
        order = np.lexsort((value[at], -score, slot, who))
        who, slot, score, found = who[order], slot[order], score[order], value[at][order]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])
        start = np.flatnonzero(fresh)
        place = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        keep = place < k
        yield pa.RecordBatch.from_arrays(
            [
                here.column("search").combine_chunks().take(pa.array(who[keep])), pa.array(wanted[who[keep]]),
                pa.array(slot[keep].astype(np.int32)), pa.array(score[keep]), pa.array(found[keep]),
            ],
            names=["search", "label", "slot", "score", "id"],
        )

    return meet(entries, visits, compare, FOUND)


def _search(asked: DataFrame, entries: DataFrame, index, same: bool, k: int, dim_type: str, work: Scratch) -> DataFrame:
    """The first ``k`` rows of the same or another label in each window of every search.

    The home leaf of a search comes first.  Where it gives ``k`` rows of a
    window, the window shrinks to scores not below the last of them, before the other
    leaves are eliminated.
    """
    first = work.stage(_exact(entries, work.stage(_visits(asked, index, True, dim_type)), same, k))
    last = first.groupBy("search", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= k)
    known = last.groupBy("search").agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("known"))
    tighter = F.transform("low", lambda s, i: F.greatest(s, F.coalesce(F.col("known")[i], s)))
    narrowed = asked.join(known, "search", "left").withColumn("low", tighter)
    others = _exact(entries, work.stage(_visits(narrowed, index, False, dim_type)), same, k)
    return work.stage(first_per(first.unionByName(others), ["search", "slot"], [F.desc("score"), F.col("id")], k))


def _whole(vector: str, scale: int) -> Column:
    """Components as whole numbers; NULL if one is missing, not finite or would not fit the scores."""
    kept = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < float(1 << LARGEST_BITS), F.lit(False)))
    return F.when(fits & (F.size(vector) > 0), kept)


def mine(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    p: Mining = Mining(),
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on the rows.  Components become
    ``floor(scale * x)``; a row's score is its inner product with the anchor,
    higher scores come first, ties by smaller id.  An anchor's positives are its
    first rows of the same label, and the negatives of a positive the first
    rows of other labels whose score lies between the two shares of the
    positive's.  Everything is exact.

    Rows with a NULL id, label or vector, or with a component that is NULL or
    not finite, take no part, nor do empty vectors and those with a scaled
    component of 2^23 or more (their scores could exceed 64 bits).  Vectors of
    different lengths are not compared; each length has a tree of its own.  Rows that repeat id, label
    and vector count once; a row is never its own positive.  Positives without a negative have no row, an
    empty table gives an empty result, other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    work = Scratch(spark)
    named = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        _whole(vector, p.scale).alias("v"), anchors.alias("asks"),
    )
    rows = work.stage(named.dropna(subset=["id", "label", "v"]).withColumn("dim", F.size("v")))
    found = None
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        part = _mine_length(rows.where(F.col("dim") == dim), dim, p, work)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], RESULT)
    return found


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mine_length(rows: DataFrame, dim: int, p: Mining, work: Scratch) -> DataFrame:
    """Mining over vectors of one length."""
    spark = rows.sparkSession
    # Of equal rows, only this many of the smallest ids can be asked for.
    keep = max(p.positives + 1, p.negatives)
    entries = work.stage(
        equal_vectors(rows, ["v", "label"], "id", keep).withColumn("node", F.xxhash64("v", "label"))
    )
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    size = entries.agg(F.count("*").alias("n"), F.max(square).alias("length")).first()
    asking = rows.where("asks").select("id", "label", "v").distinct()
    asked = work.stage(asking.groupBy("v", "label").agg(F.min("id").alias("search")).withColumnRenamed("v", "w"))

    wanted = max(1, min(p.sample_rows, p.sample_numbers // dim))
    million = 1_000_000
    share = min(million, -(-2 * wanted * million // max(size["n"], 1)))
    picked = entries.where(F.pmod(F.xxhash64("v", F.lit(p.seed)), F.lit(million)) < share).select("v").limit(wanted).toArrow()
    sample = matrix(picked.column("v")) if picked.num_rows else np.zeros((0, dim))
    tree = with_ranges(plant(sample, float(size["length"] or 0), p, size["n"]), entries, "v")
    shared = spark.sparkContext.broadcast(tree)

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            leaf = shared.value.leaf(x, shared.value.extra(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "bucket"])

    shape = "v array<long>, entry_label long, ids array<long>, node long, bucket long"
    placed = work.stage(entries.withColumnRenamed("label", "entry_label").mapInArrow(to_leaves, shape))
    counts = np.zeros(tree.leaves, np.int64)
    # As many rows as the tree has leaves.
    for r in placed.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    index = spark.sparkContext.broadcast(Index(tree, Layout.of(counts)))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = mix(batch.column("node").to_numpy().astype(np.uint64))
            block = index.value.layout.block_of(batch.column("bucket").to_numpy(), number)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", *batch.schema.names])

    blocks = placed.mapInArrow(to_blocks, f"block long, {shape}").drop("node")
    open_window = {"low": F.array(F.lit(LEAST + 1)), "high": F.array(F.lit(GREATEST))}
    mates = _search(asked.withColumns(open_window), blocks, index, True, p.positives + 1, "array<long>", work)
    # Every positive score of a search is a window of its own; all searches have as many, the rest empty.
    windows = mates.groupBy("search").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    slots = p.positives + 1
    bounds = windows.select("search", "scores", *_bounds("scores", p, slots))
    wide = work.stage(asked.join(bounds, "search"))
    foes = _search(wide, blocks, index, False, p.negatives, "array<long>", work)

    ranked = foes.groupBy("search", "slot").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("foes")
    )
    negatives = ranked.join(wide.select("search", "scores"), "search").select(
        "search", F.col("scores")[F.col("slot")].alias("score"), "foes"
    )
    lists = negatives.groupBy("search").agg(F.map_from_entries(F.collect_list(F.struct("score", "foes"))).alias("foes"))
    near = mates.groupBy("search").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("mates")
    )
    answers = work.stage(asked.join(near, "search").join(lists, "search").select(F.col("w").alias("v"), "label", "mates", "foes"))
    # Anchors with equal vector and label share the lists, each without itself.
    own = F.slice(F.filter("mates", lambda m: m["id"] != F.col("id")), 1, p.positives)
    pairs = asking.join(answers, ["v", "label"]).select(
        F.col("id").alias("anchor_id"), F.explode(own).alias("mate"), "foes"
    )
    score = -F.col("mate.minus")
    return pairs.select(
        "anchor_id", F.col("mate.id").alias("positive_id"), score.alias("positive_score"), F.posexplode(F.col("foes")[score]).alias("_i", "foe")
    ).select(
        "anchor_id", "positive_id", (F.col("_i") + 1).alias("rank"), F.col("foe.id").alias("negative_id"),
        "positive_score", (-F.col("foe.minus")).alias("negative_score"),
    )


def _bounds(scores: str, p: Mining, slots: int) -> list[Column]:
    """Lowest and highest score of the negatives of each positive, padded to ``slots`` windows with empty ones."""

    def rounded_down(x: Column) -> Column:
        return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))

    pad = F.slice(F.array_repeat(F.lit(1), slots), F.size(scores) + 1, slots)
    low = F.concat(F.transform(scores, lambda s: -rounded_down(-p.least_percent * s)), F.transform(pad, lambda x: F.lit(1).cast("long")))
    high = F.concat(F.transform(scores, lambda s: rounded_down(p.most_percent * s)), F.transform(pad, lambda x: F.lit(0).cast("long")))
    return [low.alias("low"), high.alias("high")]


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
),
scored AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
        list_inner_product(a.e, o.e)::BIGINT AS score
    FROM v a JOIN v o ON a.vec_id <> o.vec_id AND len(a.e) = len(o.e)
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
