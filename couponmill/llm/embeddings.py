"""Near-duplicate vectors by cosine, with randomised-rotation binary codes.

Vectors are turned by random rotations; the signs are the codes.  Groups of
bits are the keys of tables in which similar vectors meet.  A stored code holds a
byte for each component of the rotated vector: its sign is the binary
code, its size the component to within half a step.  With the correction factor
stored beside it, the inner product of the signs with another rotated vector
gives an unbiased estimate of the cosine, and codes, not vectors, travel to
the blocks.  Only vectors with a partner whose confidence bound reaches
the threshold follow there, and only those pairs are computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.llm.blocks import LINK_SCHEMA, forest, in_blocks, pairs_within, sides, whole_runs
from couponmill.llm.components import components
from couponmill.llm.shipping import ship
from couponmill.llm.words import mix
from couponmill.session import stage


@dataclass(frozen=True)
class Codes:
    """Parameters of the join."""

    threshold: float = 0.95
    recall: float = 0.9995
    # Standard errors between an estimate and the bound that decides.
    confidence: float = 4.0
    block_rows: int = 512
    seed: int = 11

    def bits(self, rows: int) -> int:
        """Bits of a key, so that a key holds about eight unrelated vectors."""
        return min(max(8, math.ceil(math.log2(max(rows, 1) / 8 + 1))), 40)

    def tables(self, bits: int) -> int:
        """Tables that find a pair at the threshold with the recall."""
        same = (1 - math.acos(self.threshold) / math.pi) ** bits
        return math.ceil(math.log(1 - self.recall) / math.log1p(-same))


# Blocks up to this many rows are compared together, to share the cost of a call.
SMALL_BLOCK = 64
# Numbers held at a time for the pairs of small blocks.
PAIR_NUMBERS = 4_000_000


@lru_cache(maxsize=16)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random rotations side by side, dim x (count * dim)."""
    random = np.random.default_rng([seed, dim])
    parts = []
    for _ in range(count):
        q, r = np.linalg.qr(random.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def code(x: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tables, rotated unit vectors and correction factors of rows of equal length.

    The correction factor is the inner product of the unit vector with its code.
    """
    dim = x.shape[1]
    count = max(1, -(-bits * tables // dim))
    turned = units(x) @ rotations(dim, count, seed)
    signs = (turned > 0)[:, : bits * tables].reshape(len(x), tables, bits)
    number = signs.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    # Tables, and vectors of different lengths, have keys of their own.
    salt = mix(np.arange(tables, dtype=np.uint64) + (np.full(tables, dim, np.uint64) << np.uint64(16)))
    keys = mix(number ^ salt)
    first = turned[:, :dim]
    return keys.astype(np.int64), first, np.abs(first).sum(axis=1) / math.sqrt(dim)


def _bound(product: np.ndarray, factor: np.ndarray, dim: int, confidence: float) -> np.ndarray:
    """Upper bounds from inner products of codes with rotated vectors."""
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))
    return product / math.sqrt(dim) / factor + confidence * error


def upper_bounds(first: np.ndarray, factor: np.ndarray, other: np.ndarray, confidence: float) -> np.ndarray:
    """Upper confidence bounds of the cosines of coded rows with other rotated vectors."""
    return _bound(np.where(first > 0, 1.0, -1.0) @ other.T, factor[:, None], first.shape[1], confidence)


def stored_codes(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each component of rotated vectors, of the same sign, and the step of each row."""
    step = np.abs(first).max(axis=1) / 127
    return np.clip(np.floor(first / step[:, None]), -128, 127).astype(np.int8), step


def turned_from(codes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Rotated vectors of stored codes; a component is at most half a step off."""
    return (codes + 0.5) * step[:, None]


def _slices(pairs: int, width: int) -> Iterator[slice]:
    """Parts of so many pairs that rows of ``width`` numbers fit in memory."""
    step = max(1, PAIR_NUMBERS // max(width, 1))
    return (slice(i, i + step) for i in range(0, pairs, step))


def _by_slices(pairs: int, width: int, f: Callable[[slice], np.ndarray]) -> np.ndarray:
    """``f`` of all pairs, a part at a time."""
    return np.concatenate([np.zeros(0, bool), *map(f, _slices(pairs, width))])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A large block by itself or small ones together: vectors of one length, and the rows where blocks begin."""
    for table, starts in whole_runs(batches, ["bucket", "lo", "hi"]):
        ends = np.append(starts[1:], table.num_rows)
        lo, hi = table.column("lo").to_numpy()[starts], table.column("hi").to_numpy()[starts]
        alone = (ends - starts > SMALL_BLOCK) | (lo != hi)
        dim = pc.binary_length(table.column("code")).to_numpy()[starts]
        new = np.ones(len(starts), bool)
        new[1:] = alone[1:] | alone[:-1] | (dim[1:] != dim[:-1])
        at = np.append(np.flatnonzero(new), len(starts))
        for i, j in zip(at[:-1], at[1:]):
            yield table.slice(starts[i], ends[j - 1] - starts[i]), starts[i:j] - starts[i]


def _likely_pairs(block: pa.Table, starts: np.ndarray, p: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs whose bound, from their stored codes, reaches the threshold."""
    codes = np.stack([np.frombuffer(x, np.int8) for x in block.column("code").to_pylist()])
    step, factor = block.column("step").to_numpy(), block.column("factor").to_numpy()
    first, dim = turned_from(codes, step), codes.shape[1]
    # What half a step in each component can add to an estimate, before its correction.
    slack = math.sqrt(dim) * step / 2
    if len(starts) == 1:
        low, high = sides(block)
        bound = upper_bounds(first[low], factor[low], first[high], p.confidence) + slack[high] / factor[low][:, None]
        if low is high:
            bound[np.tril_indices(len(low))] = -1
        a, b = np.nonzero(bound >= p.threshold)
        return low[a], high[b]
    signs = np.where(first > 0, 1.0, -1.0)
    a, b = pairs_within(starts, len(first))

    def likely(part: slice) -> np.ndarray:
        i, j = a[part], b[part]
        product = np.einsum("ij,ij->i", signs[i], first[j])
        return _bound(product, factor[i], dim, p.confidence) + slack[j] / factor[i] >= p.threshold

    some = _by_slices(len(a), dim, likely)
    return a[some], b[some]


def _first_meeting(keys: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True for the pairs that share no key in a table before ``table``, that of their block."""
    number = np.arange(keys.shape[1])
    return _by_slices(
        len(a), keys.shape[1],
        lambda part: ~((keys[a[part]] == keys[b[part]]) & (number < table[a[part], None])).any(axis=1),
    )


def _matrix(column) -> list[np.ndarray]:
    return [x.values.to_numpy().astype(np.float64) for x in column]


def usable(vector: str):
    """True for a vector with a direction: no NULL, NaN or infinite component, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", p: Codes = Codes()) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other vectors of cosine >= ``threshold``,
    ``component_id`` is the smallest id reachable over links, ``kept`` marks
    that vector.  Equal vectors are compared once.  Vectors that are NULL, empty,
    zero or hold a NULL or non-finite component link with nothing; vectors of
    different lengths do not link; ids that repeat or are NULL are compared by
    their vectors; a component without any id has the id NULL; an empty table
    gives an empty table.
    """
    ship(vectors.sparkSession)
    # Single-precision vectors travel as they are; products are in double precision.
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col), F.col(vector).cast(kind).alias("_v"))
    rows = rows.withColumn("_v", F.when(usable("_v"), F.col("_v")))
    classes = rows.where("_v IS NOT NULL").groupBy("_v").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()))
    distinct, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits = p.bits(distinct)
    tables = p.tables(bits)

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors_here = _matrix(batch.column("_v"))
            made: list = [None] * len(vectors_here)
            for dim in {len(v) for v in vectors_here}:
                at = [i for i, v in enumerate(vectors_here) if len(v) == dim]
                keys, first, factor = code(np.stack([vectors_here[i] for i in at]), bits, tables, p.seed)
                for i, *row in zip(at, keys, *stored_codes(first), factor):
                    made[i] = row
            columns = [
                pa.array([row[0] for row in made], pa.list_(pa.int64())),
                pa.array([row[1].tobytes() for row in made], pa.binary()),
                *[pa.array([row[k] for row in made], pa.float64()) for k in (2, 3)],
            ]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", "keys", "code", "step", "factor"])

    coded = stage(
        classes.select("node", "_v").mapInArrow(to_codes, "node long, keys array<long>, code binary, step double, factor double")
    )
    keyed = coded.select("node", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / p.block_rows).cast("long")
    members = keyed.join(shared, "bucket").select("node", "bucket", chunks.alias("_chunks")).join(coded.drop("keys"), "node")
    place = ["bucket", "lo", "hi", "side", "node"]
    stored = ["code", "step", "factor"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, starts in _portions(batches):
            some = np.unique(np.concatenate(_likely_pairs(block, starts, p)))
            if len(some):
                yield from block.select(place + stored).take(pa.array(some)).combine_chunks().to_batches()

    likely = in_blocks(members, "bucket", "_chunks", stored).mapInArrow(
        choose, "bucket long, lo long, hi long, side long, node long, code binary, step double, factor double"
    )
    likely = (
        stage(likely)
        .join(classes.select("node", "copies", F.col("_v").alias("v")), "node")
        .repartition("bucket", "lo", "hi")
        .sortWithinPartitions("bucket", "lo", "hi")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, starts in _portions(batches):
            nodes, copies = block.column("node").to_numpy(), block.column("copies").to_numpy()
            buckets = block.column("bucket").to_numpy()
            x = np.stack(_matrix(block.column("v")))
            a, b = _likely_pairs(block, starts, p)
            unit = units(x)
            near = _by_slices(
                len(a), x.shape[1], lambda part: np.einsum("ij,ij->i", unit[a[part]], unit[b[part]]) >= p.threshold
            )
            if not near.any():
                continue
            a, b = a[near], b[near]
            # A pair belongs to the first table in which it meets.
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = code(x[used], bits, tables, p.seed)[0]
            table = np.argmax(keys == buckets[used, None], axis=1)
            new = _first_meeting(keys, table, at[: len(a)], at[len(a) :])
            a, b = a[new], b[new]
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = forest(nodes, (a, b))
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array(links[some]), pa.array(root[some])], names=["node", "n_links", "root"]
            )

    exact = stage(likely.mapInArrow(compare, LINK_SCHEMA))
    roots = components(exact.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("node").agg(F.sum("n_links").alias("_links"))
    # Copies of a vector with more than one task's share of the rows, and rows without one, are spread over the tasks.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = (F.col("copies") > total / parts).alias("_hot")
    placed = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed.select("_v", "root", "first_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), hot))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    last = F.when(F.col("_hot"), parts - 1).otherwise(0)
    found = placed.join(smallest, "root").select("_v", "n_links", "component_id", F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
    # Fewer vectors than tasks.
    marked = rows.join(F.broadcast(placed.where("_hot").select("_v", "_hot")), "_v", "left")
    spread = F.pmod(F.xxhash64(id_col) + F.spark_partition_id(), F.lit(parts)).cast("int")
    marked = marked.withColumn("_salt", F.when(F.col("_v").isNull() | F.col("_hot"), spread).otherwise(0))
    component = F.when(F.col("_v").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return (
        marked.join(found, ["_v", "_salt"], "left")
        .select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


OP4_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
    SELECT a AS vec_id, b AS other FROM links
    UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
),
roots AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(r.other, e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce(r.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN roots r ON e.vec_id = r.vec_id LEFT JOIN counts c ON e.vec_id = c.vec_id
"""
