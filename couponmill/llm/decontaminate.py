"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each slice of a partition is a shard.  Its suffix array holds the positions
whose first words occur in a test item (no other suffix can match one), in the
order of their next ``window`` words.  The suffixes of the test items are found in
it by binary search.  The longest verbatim match at a position found is the longer
common prefix with its two neighbours in the full suffix array of the items; a
match that no longer one contains is a span.  No document leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.llm.shipping import ship
from couponmill.llm.words import mix, ngrams, slices, utf8, words
from couponmill.session import stage

WINDOW = 13
# Test words held in memory at once; a larger test set takes several passes.
BLOCK_WORDS = 4_000_000
# Size of a shard of the training texts, about.
SHARD_BYTES = 4 << 20
# Leading words that decide whether a position can match any test suffix.
LEAD = 3

SPANS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length")] + [T.StructField("item", T.StringType())])
)


@dataclass
class TestSuffixes:
    """Windows of a block of test items, grouped by their length in words."""

    vocabulary: np.ndarray
    lead: np.ndarray
    lead_words: int
    #: length -> (sorted windows as rows of word codes, item of each)
    windows: dict[int, tuple[np.ndarray, np.ndarray]]
    names: list[str]
    suffixes: ItemSuffixes
    window: int


# Odd multiplier of the hashes that compare runs of words.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _prefix_hashes(code: np.ndarray) -> np.ndarray:
    """Sums of ``mix(code) * base^position``, by which runs of words are compared wherever they lie."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(code) - 1, 0), _BASE)]))[: len(code)]
        return np.concatenate([[np.uint64(0)], np.cumsum(mix(code.astype(np.uint64)) * power)])


@dataclass
class ItemSuffixes:
    """All suffixes of the items of at least a window's length, in order."""

    code: np.ndarray
    end: np.ndarray
    item: np.ndarray
    order: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, index: np.ndarray, items: np.ndarray) -> ItemSuffixes:
        """Sorted by doubling: the rank of twice as many words is a pair of ranks.  A suffix that ends sorts first."""
        end = np.repeat(index[1:], np.diff(index))
        position = np.arange(len(code))
        rank, step = code.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while len(code):
            ahead = np.where(position + step < end, rank[np.minimum(position + step, len(code) - 1)], 0)
            pair = rank * (rank.max() + 1) + ahead
            order = np.argsort(pair, kind="stable")
            fresh = np.ones(len(code), np.int64)
            fresh[1:] = pair[order][1:] != pair[order][:-1]
            rank = np.empty(len(code), np.int64)
            rank[order] = np.cumsum(fresh)
            step *= 2
            if fresh.all() or step >= (end - position).max():
                break
        return cls(code, end, np.repeat(items, np.diff(index)), order, _prefix_hashes(code))

    def common(self, hashes: np.ndarray, at: np.ndarray, end: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Words that the text from each of ``at`` has in common with an item suffix: by bisection of the hashes."""
        low = np.zeros(len(at), np.int64)
        high = np.minimum(end - at, self.end[suffix] - suffix)
        shift = np.abs(at - suffix)
        with np.errstate(over="ignore"):
            scale = _powers(shift)
            while (low < high).any():
                middle = (low + high + 1) // 2
                text = hashes[at + middle] - hashes[at]
                item = self.hashes[suffix + middle] - self.hashes[suffix]
                same = np.where(at > suffix, text == item * scale, text * scale == item)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def longest(self, code: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match at each of ``at`` in the coded texts, and an item that has it."""
        hashes = _prefix_hashes(code)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        while (low < high).any():
            middle = (low + high) // 2
            suffix = self.order[np.minimum(middle, len(self.order) - 1)]
            n = self.common(hashes, at, end, suffix)
            # Where one of the two ends, the shorter is the smaller.
            text_next = np.where(at + n < end, code[np.minimum(at + n, len(code) - 1)].astype(np.int64), -1)
            item_next = np.where(suffix + n < self.end[suffix], self.code[np.minimum(suffix + n, len(self.code) - 1)].astype(np.int64), -1)
            before = (item_next < text_next) & (low < high)
            low, high = np.where(before, middle + 1, low), np.where(before | (low >= high), high, middle)
        left, right = self.order[np.maximum(low - 1, 0)], self.order[np.minimum(low, len(self.order) - 1)]
        by_left, by_right = self.common(hashes, at, end, left), self.common(hashes, at, end, right)
        better = (by_right > by_left) | ((by_right == by_left) & (self.item[right] < self.item[left]))
        return np.maximum(by_left, by_right), np.where(better, self.item[right], self.item[left])


def _powers(exponent: np.ndarray) -> np.ndarray:
    """The base to each exponent, modulo 2^64."""
    out, square, rest = np.ones(len(exponent), np.uint64), _BASE, exponent.astype(np.uint64)
    with np.errstate(over="ignore"):
        while rest.any():
            out = np.where(rest & np.uint64(1), out * square, out)
            square, rest = square * square, rest >> np.uint64(1)
    return out


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word codes as byte strings that sort like the rows."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{4 * rows.shape[1]}")


def prepare(names: list[str], texts: list[str | None], window: int = WINDOW) -> TestSuffixes:
    """Code the words of the items and sort their windows."""
    value, index = words(*utf8(pa.array(texts, pa.string())))
    vocabulary = np.unique(value)
    # Code 0 is any word that no item has.
    code = np.searchsorted(vocabulary, value).astype(np.uint32) + 1
    rows: dict[int, list] = {}
    for item, (a, b) in enumerate(zip(index[:-1], index[1:])):
        n = min(window, b - a)
        if n:
            views = np.lib.stride_tricks.sliding_window_view(code[a:b], n)
            rows.setdefault(int(n), []).append((views, np.full(len(views), item)))
    windows = {}
    for n, parts in rows.items():
        packed = _packed(np.concatenate([p[0] for p in parts]))
        order = np.argsort(packed, kind="stable")
        windows[n] = packed[order], np.concatenate([p[1] for p in parts])[order]
    lead_words = min([LEAD, *windows])
    lead = np.zeros(0, np.uint64)
    if windows:
        runs, _ = ngrams(code.astype(np.uint64), index, lead_words)
        lead = np.unique(runs)
    long = np.flatnonzero(np.diff(index) >= window)
    parts = [code[index[i] : index[i + 1]] for i in long]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    suffixes = ItemSuffixes.of(np.concatenate([np.zeros(0, np.uint32), *parts]), begins, long)
    return TestSuffixes(vocabulary, lead, lead_words, windows, names, suffixes, window)


def text_codes(test: TestSuffixes, value: np.ndarray) -> np.ndarray:
    """Codes of the words of texts; 0 for a word that no item has."""
    if not len(test.vocabulary):
        return np.zeros(len(value), np.uint32)
    at, known = _member(test.vocabulary, value)
    return np.where(known, at + 1, 0).astype(np.uint32)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == x


def matches(test: TestSuffixes, value: np.ndarray, index: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: positions in the shard and the item that occurs there."""
    if not len(value) or not test.windows:
        return
    code = text_codes(test, value)
    known = code > 0
    text_end = np.repeat(index[1:], np.diff(index))
    lead = test.lead_words
    run = np.zeros(len(code), np.uint64)
    full = len(code) - lead + 1
    if full < 1:
        return
    # The same numbers as ngrams() gives the leading words of an item.
    for k in range(lead):
        run[:full] = run[:full] * np.uint64(0x9E3779B97F4A7C15) + code[k : k + full].astype(np.uint64)
    left = np.arange(len(code)) + lead <= text_end
    left &= known
    left[np.flatnonzero(left)] = _member(test.lead, mix(run[left]))[1]
    start = np.flatnonzero(left)
    for n, (windows, items) in test.windows.items():
        begin = start[start + n <= text_end[start]]
        # A position with an unknown word within its window matches nothing.
        unknown = np.concatenate([[0], np.cumsum(code == 0)])
        begin = begin[unknown[begin + n] == unknown[begin]]
        if not len(begin):
            continue
        suffixes = _packed(np.lib.stride_tricks.sliding_window_view(code, n)[begin])
        order = np.argsort(suffixes, kind="stable")
        suffix_array, suffixes = begin[order], suffixes[order]
        distinct = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
        low = np.searchsorted(suffixes, windows[distinct], "left")
        high = np.searchsorted(suffixes, windows[distinct], "right")
        last = np.concatenate([distinct[1:], [len(windows)]])
        for i in np.flatnonzero(high > low):
            for item in np.unique(items[distinct[i] : last[i]]):
                yield n, suffix_array[low[i] : high[i]], np.int64(item)


def _shard_spans(test: TestSuffixes, value: np.ndarray, index: np.ndarray) -> tuple[list[list[dict]], list[list[str]]]:
    """Longest verbatim matches of every text of a shard (first word, words, item), and all items that occur in it."""
    spans: list[list[dict]] = [[] for _ in range(len(index) - 1)]
    items: list[set] = [set() for _ in range(len(index) - 1)]
    starts = [np.zeros(0, np.int64)]
    for n, position, item in matches(test, value, index):
        text = np.searchsorted(index, position, "right") - 1
        for t in np.unique(text):
            items[t].add(test.names[item])
        if n < test.window:
            # A short item occurs as a whole.
            for t, start in zip(text, position - index[text]):
                spans[t].append({"start": int(start), "length": int(n), "item": test.names[item]})
        else:
            starts.append(position)
    position = np.unique(np.concatenate(starts))
    if len(position):
        text = np.searchsorted(index, position, "right") - 1
        length, item = test.suffixes.longest(text_codes(test, value), position, index[text + 1])
        # A match is left out if the one that starts a word before reaches as far.
        whole = np.ones(len(position), bool)
        whole[1:] = (np.diff(position) > 1) | (np.diff(text) > 0) | (length[1:] >= length[:-1])
        for t, start, n, i in zip(text[whole], (position - index[text])[whole], length[whole], item[whole]):
            spans[t].append({"start": int(start), "length": int(n), "item": test.names[i]})
    return spans, [sorted(found) for found in items]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[str], list[str | None]]]:
    """The test items in blocks of at most BLOCK_WORDS words (a longer item alone)."""
    names, texts, size = [], [], 0
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), text).distinct()
    for name, content in named.toLocalIterator():
        n = len(content or "") // 2 + 1
        if names and size + n > BLOCK_WORDS:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(name)
        texts.append(content)
        size += n
    yield names, texts


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items``, ``longest``, ``spans`` and ``contaminated``.

    A hit word lies inside an occurrence of ``window`` consecutive words of an
    item, or of a whole shorter item.  ``spans`` are the longest verbatim
    matches (first word, words, item), ``items`` the distinct ids as sorted
    strings.  A document is contaminated if at least one in twenty of its words
    is hit.  NULL, empty and wordless texts and items match nothing; items that
    repeat count once; a NULL item id is called ``null``; an empty table of
    items leaves every document clean; columns of the same names are replaced, all others pass through.
    A span names one item; where several have the match, it is one of them.

    The items reach the workers in blocks of BLOCK_WORDS words.  One block, the
    usual case, is one pass over the documents; for more, the documents are
    written once and read once for each block.
    """
    spark = docs.sparkSession
    ship(spark)
    # Own names, so that no column of the input can clash with those made here.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*names)
    text = next(k for k, c in names.items() if c == text)
    blocks = _blocks(items, item_id, item_text)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        found = _pass(docs, text, first, window)
    else:
        docs = stage(docs.withColumn("row", F.monotonically_increasing_id()))
        parts, block = None, first
        while block is not None:
            hits = _pass(docs.select("row", text), text, block, window)
            hits = stage(hits.where(F.size("spans") > 0).select("row", "spans", "items"))
            parts = hits if parts is None else parts.union(hits)
            block, second = second, next(blocks, None)
        merged = parts.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")])
        counts = _pass(docs, text, ([], []), window).drop("spans", "items")
        found = counts.join(merged, "row", "left").drop("row")
        found = found.withColumns({
            "spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>")),
        })
    return _decide(found, names)


def _pass(docs: DataFrame, text: str, block: tuple, window: int) -> DataFrame:
    """Add the word count, and the spans and items of the matches with one block of items."""
    test = docs.sparkSession.sparkContext.broadcast(prepare(*block, window))
    made = [("words", T.LongType()), ("spans", SPANS), ("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in made]])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                value, index = words(*utf8(part.column(text)))
                spans, items = _shard_spans(test.value, value, index)
                columns = [pa.array(np.diff(index)), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def _decide(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """Count the covered words, apply the rule and give the columns their names back."""
    # Words already covered, and the end of the cover, over the matches in order.
    empty = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    cover = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["start"] + s["length"]))),
        empty,
        lambda done, s: F.struct(
            (done["hit"] + F.greatest(s["col2"] - F.greatest(s["start"], done["end"]), F.lit(0).cast("long"))).alias("hit"),
            F.greatest(done["end"], s["col2"]).alias("end"),
        ),
    )
    made = {
        "n_words": F.col("words"),
        "n_hit": cover["hit"],
        "items": F.array_sort(F.array_distinct("items")),
        "longest": F.coalesce(F.array_max(F.transform("spans", lambda s: s["length"])), F.lit(0).cast("long")),
        "spans": F.col("spans"),
    }
    kept = [F.col(k).alias(c) for k, c in names.items() if c not in {*made, "contaminated"}]
    table = found.select(*kept, *[c.alias(n) for n, c in made.items()])
    return table.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    names = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names).withColumn("text", F.col(next(k for k, v in names.items() if v == "text")))
    kept = contamination(plain, items).where(~F.col("contaminated"))
    return kept.select(*[F.col(k).alias(v) for k, v in names.items()])


OP3_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark
),
test AS (
    SELECT item_id, j, least(len(w), 13) AS n, array_to_string(w[j : j + least(len(w), 13) - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS j FROM b WHERE len(w) > 0)
),
here AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM test) WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, i, j, n FROM here JOIN test USING (n, words)),
hits AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1
),
-- Windows that follow one another in text and item are one match.
chains AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - j ORDER BY i) AS chain FROM found),
matches AS (SELECT doc_id, max(n) + count(*) - 1 AS length FROM chains GROUP BY doc_id, item_id, n, i - j, chain),
longest AS (SELECT doc_id, max(length)::BIGINT AS longest FROM matches GROUP BY 1),
names AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
    coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN names ON d.doc_id = names.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id
"""
