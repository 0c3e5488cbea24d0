"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over a
URL.  A hit counts if it is bounded by other characters than letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.llm.shipping import ship

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_WORD = frozenset(_LOWER + "0123456789")


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the filter.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)

# Strict terms reject alone; soft terms by the number of different ones.
STRICT = ("casino", "porn", "xxx", "viagra", "pills", "escort", "malware", "warez")
SOFT = ("ads", "bet", "bets", "cheap", "click", "farm", "free", "loan", "prize", "spam", "track", "win")
SOFT_LIMIT = 2


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.text).otherwise(name)
        verdict = F.when(fits, "allow" if rule.allow else "block").otherwise(verdict)
    return name, verdict


def count_terms(df: DataFrame, url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> DataFrame:
    """Add ``strict_hits`` and ``soft_terms``: bounded strict hits, different bounded soft terms."""
    ship(df.sparkSession)
    made = ("strict_hits", "soft_terms")
    names = [c for c in df.columns if c not in made]
    schema = T.StructType([*[df.schema[c] for c in names], *[T.StructField(c, T.IntegerType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        wanted = frozenset(strict)

        def judge(text: str) -> tuple[int, int]:
            text = text.translate(_FOLD)
            hits, seen = 0, set()
            for end, term in automaton.iter(text):
                start = end - len(term)
                if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                    if term in wanted:
                        hits += 1
                    else:
                        seen.add(term)
            return hits, len(seen)

        for batch in batches:
            found = [judge(u or "") for u in batch.column(url).to_pylist()]
            counts = [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *counts], names=schema.names)

    return df.mapInArrow(run, schema)


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``strict_hits``, ``soft_terms``, ``rule`` and ``verdict``.

    The longest rule decides; without one, a URL is blocked for one strict term
    or ``soft_limit`` different soft ones.  NULL, empty and odd URLs have an
    empty host and path and no rule, and are judged by their terms like any
    other; rows that repeat are judged alike; columns of the same names are
    replaced; an empty table stays empty.
    """
    counted = count_terms(pages, url)
    host, path = host_path(url)
    split = counted.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_terms") >= soft_limit), "block").otherwise("allow")
    return split.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})


def _sql_hits(terms: tuple[str, ...], call: str) -> str:
    return " + ".join(call.format(t) for t in terms)


_SQL_FOLD = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"

OP1_SQL = f"""
WITH split AS (
    SELECT page_id, url, {_SQL_FOLD} AS u,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
parts AS (
    SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
        ({_sql_hits(STRICT, "(regexp_matches(u, '(^|[^a-z0-9]){}([^a-z0-9]|$)'))::INTEGER")}) AS strict_terms,
        ({_sql_hits(SOFT, "(regexp_matches(u, '(^|[^a-z0-9]){}([^a-z0-9]|$)'))::INTEGER")}) AS soft_terms
    FROM split
),
fit AS (
    SELECT p.page_id, r.rule, r.verdict FROM parts p JOIN (VALUES
        {", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{'allow' if r.allow else 'block'}')" for r in RULES)}
    ) r(host, path, rule, verdict)
    ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path)
),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY 1)
SELECT p.page_id, p.host, p.path, b.rule,
    coalesce(b.verdict, CASE WHEN strict_terms > 0 OR soft_terms >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""
