"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponmill.session import stage

RATIO = 0.1
# A line on one page alone repeats nothing, whatever share of a tiny host that page is.
MIN_PAGES = 2
# Beyond this many boilerplate lines the lists are joined by shuffle instead of broadcast.
BROADCAST_LINES = 200_000
# Pages of a host that one task of that shuffle gets at most, about.
PAGES_PER_SALT = 100_000


def _key(line: Column) -> Column:
    """Identity of a line: its text without outer blanks, as a 128-bit digest."""
    return F.md5(F.trim(line).cast("binary"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def line_shares(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``host``, ``line_key``, ``pages`` with the line, ``total`` pages and ``ratio``.

    A line that a page repeats counts once for the page; blank lines are not counted.
    """
    pages = docs.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))
    counts = (
        docs.select(F.col(host).alias("_host"), F.explode(keys).alias("line_key"))
        .groupBy("_host", "line_key")
        .agg(F.count("*").alias("pages"))
    )
    total = F.col("total")
    return counts.join(pages, counts["_host"].eqNullSafe(pages["_host"])).select(
        counts["_host"].alias(host), "line_key", "pages", total, (F.col("pages") / total).alias("ratio")
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
) -> DataFrame:
    """``docs`` without the lines that more than ``ratio`` of the host's pages contain.

    Adds ``lines_dropped``; a column of that name is replaced.  A line on a
    single page of its host stays, so a host of one page loses nothing; beyond
    that the ratio alone decides, also on small hosts: a menu on 4 of 4 pages goes.
    The other lines keep their order and form; a page can end up empty but stays.
    NULL and empty texts stay as they are and count as pages; pages without a
    host form one host; an empty table stays empty; pages that repeat count
    each.  Other columns pass through, whatever their names.

    The pages themselves are not regrouped: every host's boilerplate lines, of
    which there are at most (lines of a page / ratio), come to its pages.
    """
    # Own names, so that no column of the input can clash with those made here.
    names = {f"c{i}": c for i, c in enumerate(docs.columns) if c != "lines_dropped"}
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()])
    keys = {c: k for k, c in names.items()}
    done = _without_boilerplate(plain, keys[host], keys[text], ratio)
    return done.select(*[F.col(k).alias(c) for k, c in names.items()], "lines_dropped")


def _without_boilerplate(docs: DataFrame, host: str, text: str, ratio: float) -> DataFrame:
    frequent = stage(
        line_shares(docs, host, text)
        .where((F.col("pages") >= MIN_PAGES) & (F.col("pages") > F.lit(ratio) * F.col("total")))
        .select(F.col(host).alias("_host"), "line_key", "total")
    )
    lists = frequent.groupBy("_host").agg(F.collect_list("line_key").alias("_bad"), F.max("total").alias("_total"))
    here = F.col(host).eqNullSafe(F.col("_host"))
    if frequent.count() <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(lists.drop("_total")), here, "left")
    else:
        # A host's list is repeated once for every PAGES_PER_SALT of its pages.
        last = F.floor(F.col("_total") / PAGES_PER_SALT).cast("long")
        salted = lists.withColumn("_last", last).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
        sizes = docs.groupBy(F.col(host).alias("_host")).agg(F.floor(F.count("*") / PAGES_PER_SALT).alias("_last"))
        sizes = F.broadcast(sizes.where("_last > 0"))
        spread = docs.join(sizes, here, "left").withColumn(
            "_salt", F.pmod(F.xxhash64(text), F.coalesce("_last", F.lit(0)) + 1)
        )
        spread = spread.drop("_host", "_last")
        joined = spread.join(salted.drop("_last", "_total"), here & (spread["_salt"] == salted["_salt"]), "left")
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains("_bad", _key(x)), F.lit(False)))
    work = joined.select(*docs.columns, "_bad").withColumn("_kept", F.when(F.col("_bad").isNotNull(), kept))
    dropped = F.coalesce(F.size(_lines(text)) - F.size("_kept"), F.lit(0))
    new_text = F.when(dropped > 0, F.array_join("_kept", "\n")).otherwise(F.col(text))
    return work.select(*[new_text.alias(c) if c == text else F.col(c) for c in docs.columns], dropped.alias("lines_dropped"))


OP10_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, n, string_split(text, chr(10))[n] AS line
    FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
    SELECT c.source, c.line
    FROM (
        SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages
        FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2
    ) c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
    WHERE pages >= {MIN_PAGES} AND pages > {RATIO}::DOUBLE * total
),
kept AS (
    SELECT doc_id, string_agg(l.line, chr(10) ORDER BY n) FILTER (WHERE b.line IS NULL) AS text,
        count(b.line)::INTEGER AS lines_dropped
    FROM lines l LEFT JOIN bad b
        ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line
    GROUP BY doc_id
)
SELECT d.doc_id, d.source,
    CASE WHEN k.lines_dropped > 0 THEN coalesce(k.text, '') ELSE d.text END AS text,
    coalesce(k.lines_dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
