"""Divergence audit between the sources of every language, over a three-dimensional cube.

Each group (language and source) is a row of smoothed term shares.  The groups are
cut into blocks and the terms into blocks, and a task owns a cell (group block,
group block, term block): the slices of both group blocks within the term
block are copied to it, it sums the divergences of all its pairs of groups over its
terms, and the sums of the cells are added up along the term axis.  So neither a
large group, a frequent term nor a language with many sources is one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from couponmill.llm.blocks import runs
from couponmill.llm.shipping import ship
from couponmill.llm.visits import first_per
from couponmill.operators.ordering import sized_broadcast
from couponmill.session import Scratch

# Everything that is no letter of a term becomes a blank, A-Z become small.
_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(_FOLD)
# A longer text is counted in pieces of about this many bytes.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Audit:
    """Parameters of the shares and of the cube."""

    least_documents: int = 30
    smoothing: int = 5
    unit: int = 1_000_000_000
    top_terms: int = 50
    group_block: int = 32
    term_block: int = 8_192
    # Counts that a task gathers before it passes them on.
    held_counts: int = 400_000


def terms_of(text: bytes) -> Counter:
    """Occurrences of every term of a text: runs of letters and non-ASCII characters, A-Z lower-cased."""
    counts: Counter = Counter()
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split(b" "))
        at = end
    del counts[b""]
    return counts


def group_counts(docs: DataFrame, group: list[str], text: str, p: Audit = Audit()) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences and ``docs`` with the term.

    Every group that occurs has one row with a NULL term.  Counts are added up within each task
    before they are shuffled.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def passed_on(held: dict) -> pa.RecordBatch:
        rows = [(*g, t, *c) for g, terms in held.items() for t, c in terms.items()]
        terms = pa.array([t for _, _, t, _, _ in rows], pa.binary()).cast(pa.string())
        columns = [[r[i] for r in rows] for i in (0, 1, 3, 4)]
        columns = [pa.array(c, schema.field(i).type) for c, i in zip(columns, (0, 1, 3, 4))]
        return pa.RecordBatch.from_arrays([*columns[:2], terms, *columns[2:]], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(dict)
        size = 0
        for batch in batches:
            for lang, source, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "body"))):
                own = held[lang, source]
                own.setdefault(None, [0, 0])
                before = len(own)
                for term, n in terms_of(body or b"").items():
                    seen = own.get(term)
                    if seen is None:
                        own[term] = [n, 1]
                    else:
                        seen[0] += n
                        seen[1] += 1
                size += len(own) - before
                if size > p.held_counts:
                    yield passed_on(held)
                    held.clear()
                    size = 0
        if held:
            yield passed_on(held)

    empty = F.lit("")
    named = docs.select(
        *[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in zip(group, ("lang", "source"))],
        F.col(text).cast("binary").alias("body"),
    )
    counted = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, p: Audit) -> Column:
    """Smoothed share of a term in whole units, rounded down, plus one; 0 where there are no terms.

    Exact: the products are decimals, which also hold counts beyond 64 bits.
    """
    wide = "decimal(38,0)"
    above = (n.cast("decimal(20,0)") + p.smoothing) * F.lit(p.unit).cast("decimal(12,0)")
    below = total.cast("decimal(24,0)") + terms.cast("decimal(20,0)") * p.smoothing
    quotient = F.call_function("div", above.cast(wide), below.cast(wide))
    return F.when(terms > 0, quotient + 1).otherwise(F.lit(0).cast("long"))


CELL = "lang string, a long, b long, part long"


def _cell_pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """Partial divergences of the pairs of groups of one cell.

    The cell's table has a header row for every group (NULL term, share of an absent term)
    and the terms that groups have.  ``part`` is the sum over the cell's terms, less what the pair's
    absent terms would give there; the header of term block 0 brings that for all terms.
    """
    lang, tile = cell.column("lang")[0], cell.column("tile")[0].as_py()
    group, side = cell.column("gid").to_numpy(), cell.column("side").to_numpy()
    term = cell.column("tid").fill_null(-1).to_numpy()
    value = cell.column("share").to_numpy()
    header = term < 0
    groups = np.sort(group[header])
    absent = np.zeros(len(groups), np.int64)
    absent[np.searchsorted(groups, group[header])] = value[header]
    sides = np.zeros(len(groups), np.int64)
    sides[np.searchsorted(groups, group[header])] = side[header]
    terms = np.unique(term[~header])
    table = np.repeat(absent[:, None], len(terms), axis=1)
    table[np.searchsorted(groups, group[~header]), np.searchsorted(terms, term[~header])] = value[~header]
    lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
    total = cell.column("terms")[0].as_py() if tile == 0 else 0
    left, right = np.flatnonzero(sides == lo), np.flatnonzero(sides == hi)
    for i in left:
        others = right[right > i] if lo == hi else right
        apart = np.abs(absent[others] - absent[i])
        part = np.abs(table[others] - table[i]).sum(axis=1) + (total - len(terms)) * apart
        if len(others):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py()] * len(others)), pa.array(np.full(len(others), groups[i])), pa.array(groups[others]), pa.array(part)],
                names=["lang", "a", "b", "part"],
            )


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", p: Audit = Audit()) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    A language keeps the terms in at least ``p.least_documents`` of its
    documents.  Each kept term has a smoothed share in every group (a source
    of the language) and in the whole language.  ``part`` is ``pair`` for the
    summed absolute differences to each other source of the language, and
    ``term`` for the first ``p.top_terms`` terms that the group has and uses more than its
    language does, with the difference.  Ranks run by falling value, then by the item's bytes.

    NULL languages, sources and texts are empty texts, so they form groups of
    their own; a text without terms still makes its group occur; very long texts are counted in pieces; rows that
    repeat count each; a language without kept terms has pairs of value 0; a
    language of one source has no pairs; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Scratch(spark)
    counts = work.stage(group_counts(docs, [lang, source], text, p))
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = work.stage(by_term.where(F.col("docs") >= p.least_documents).drop("docs").withColumn("tid", F.monotonically_increasing_id()))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = sized_broadcast(work.stage(langs))
    found = work.stage(counts.join(kept, ["lang", "term"]))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (
        counts.where("term IS NULL").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    )
    groups = work.stage(groups.withColumn("gid", F.monotonically_increasing_id()))
    slices = work.stage(
        found.join(sized_broadcast(groups), ["lang", "source"]).select(
            "lang", "source", "term", "gid", "tid", "terms",
            share(F.col("n"), F.col("total"), F.col("terms"), p).alias("share"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), p).alias("lang_share"),
        )
    )
    above = slices.where("share > lang_share").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value")
    )
    order = [F.desc("value"), F.col("item")]
    top = first_per(above, ["lang", "source"], order, p.top_terms)
    return _ranked(top.unionByName(_pairs(groups, slices, p, work)), order)


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    return rows.select("lang", "source", "part", "item", "value", place.alias("rank"))


def _pairs(groups: DataFrame, slices: DataFrame, p: Audit, work: Scratch) -> DataFrame:
    """Both directions of every pair of sources of a language, from the cube."""
    sizes = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / p.group_block).cast("long").alias("blocks"),
        F.greatest(F.ceil(F.max("terms") / p.term_block).cast("long"), F.lit(1).cast("long")).alias("tiles"),
    )
    sizes = sized_broadcast(work.stage(sizes))
    every_tile = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")
    nothing = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), p)
    headers = groups.join(sizes, "lang").select(
        "lang", "gid", F.lit(None).cast("long").alias("tid"), "terms", nothing.alias("share"), "blocks", every_tile
    )
    tile = F.pmod(F.xxhash64("tid"), F.col("tiles")).alias("tile")
    rows = headers.unionByName(slices.join(sizes, "lang").select("lang", "gid", "tid", "terms", "share", "blocks", tile))
    side = F.pmod(F.xxhash64("gid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cube = rows.withColumn("side", side).select("*", other).select(
        "lang", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "tile", "side", "gid", "tid", "terms", "share",
        F.xxhash64("lang").alias("key"),
    )
    cell = ["key", "lo", "hi", "tile"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, cell):
            # Languages whose keys agree by chance are told apart.
            for name in run.column("lang").unique():
                yield from _cell_pairs(run.filter(pc.equal(run.column("lang"), name)))

    parts = cube.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(cells, CELL)
    sums = work.stage(parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = sized_broadcast(groups.select("gid", "source"))
    return (
        both.join(names.withColumnsRenamed({"gid": "a"}), "a")
        .join(names.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )


OP12_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
w AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM kept GROUP BY 1),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0)::HUGEINT + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.ln + 5)) // (l.lt::HUGEINT + 5 * l.v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
),
rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source AS xs, y.source AS ys, sum(abs(x.p - y.p)) AS value
        FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
    ) s ON s.lang = a.lang AND s.xs = a.source AND s.ys = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows
QUALIFY part = 'pair' OR rank <= 50
"""
