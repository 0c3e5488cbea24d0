"""Multi-index search, hard negatives and source divergence against brute force."""

import re
import resource
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from couponmill.llm import catalog, divergence, hyperplanes, multiindex, visits  # noqa: E402
from sqlcheck import compare  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label int, bucket string, search string, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], VECTORS)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_divergence"])
def test_query_equals_sql(spark, sf_dir, name):
    assert compare.difference(spark, sf_dir, compare.connect(sf_dir), catalog.QUERIES[name], catalog.ORACLE[name]) is None


def odd_vectors():
    """Clusters, many equal vectors, ties, and rows that take no part."""
    random = np.random.default_rng(3)
    centre = random.standard_normal((6, 8))
    rows = [(i, (centre[i % 6] + 0.1 * random.standard_normal(8)).tolist(), i % 3) for i in range(400)]
    rows += [(400 + i, centre[0].tolist(), i % 2) for i in range(300)]
    rows += [(700 + i, (2 * centre[1]).tolist(), 1) for i in range(40)]
    bad = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    rows += [(800 + 50 * i, v, 1) for i, v in enumerate(bad)]
    # Another length, a NULL id, a NULL label, a row that repeats.
    rows += [(1200 + 50 * i, [1.0 + i, 2.0, -1.0], i % 2) for i in range(4)]
    rows += [(None, [1.0] * 8, 1), (1500, [1.0] * 8, None), rows[0], rows[0], rows[405]]
    return rows


def usable(rows, zero_too=False):
    out = {}
    for i, v, label in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not (zero_too or any(v)):
            continue
        out[i, tuple(v), label] = (i, np.array(v), label)
    return list(out.values())


def test_nearest_equals_brute_force_with_a_full_quota(spark):
    rows = odd_vectors()
    found = defaultdict(list)
    p = multiindex.MultiIndex(recall=1.0, cell_rows=4)
    for r in multiindex.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, p=p).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = usable(rows)
    asked = [(i, v) for i, v, _ in good if i % 50 == 0]
    agree = total = 0
    for i, v in asked:
        others = {}
        for j, w, _ in good:
            if j != i and len(w) == len(v):
                others[j] = max(others.get(j, -2), round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12))
        want = sorted(others.items(), key=lambda x: (-x[1], x[0]))[:5]
        have = sorted(found[i])
        assert [r for r, _, _ in have] == list(range(1, len(want) + 1))
        assert [s for _, _, s in have] == pytest.approx([s for _, s in want], abs=0.2)
        agree += len({j for j, _ in want} & {j for _, j, _ in have})
        total += len(want)
    assert set(found) == {i for i, _ in asked} and agree >= 0.97 * total


def test_recall_of_the_query(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in rows])
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        want |= {(ids[i], ids[j]) for j in np.argsort(-score)[:5]}
    got = [(r["query_id"], r["vec_id"]) for r in catalog.QUERIES["op13_nearest_neighbours"](spark, sf_dir).collect()]
    assert len(got) == len(want) and len(want & set(got)) >= 0.9 * len(want)


def test_few_rows_are_all_neighbours(spark):
    near = multiindex.nearest(vectors(spark, [(0, [1.0, 0.0], 1), (50, [0.0, -1.0], 1), (3, [-1.0, 0.0], 1)]), F.col("vec_id") % 50 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in near.collect()) == [
        (0, 1, 50, 0.0), (0, 2, 3, -1.0), (50, 1, 0, 0.0), (50, 2, 3, 0.0),
    ]
    for f in (multiindex.nearest, hyperplanes.mine):
        assert f(vectors(spark, [(0, [1.0], 1)]), F.col("vec_id") % 50 == 0).count() == 0
        assert f(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_cells_come_by_summed_distance():
    random = np.random.default_rng(1)
    a, b, counts = random.random(7), random.random(9), random.integers(0, 4, 63)
    sums = (a[:, None] + b).ravel()
    order = [c for c in np.argsort(sums, kind="stable") if counts[c]]
    for quota in (1, 10, 40, 10_000):
        cells = multiindex.nearest_cells(a, b, counts, quota)
        assert cells == order[: len(cells)]
        assert counts[cells].sum() >= min(quota, counts.sum()) > counts[cells[:-1]].sum() or len(cells) == len(order)
    before = multiindex.entries_before(a, b, counts, np.array(order[:5]))
    assert before.tolist() == [counts[order[:i]].sum() for i in range(5)]


def test_long_walks_sort_the_sums(monkeypatch):
    random = np.random.default_rng(2)
    a, b, counts = random.random(30), random.random(40), random.integers(0, 4, 1200)
    sums = (a[:, None] + b).ravel()
    for quota in (1, 300, 900, 10_000):
        walked = [multiindex.nearest_cells(a, b, counts, quota)]
        for pairs in (0, 5, 2_000):
            monkeypatch.setattr(multiindex, "HEAP_PAIRS", pairs)
            walked.append(multiindex.nearest_cells(a, b, counts, quota))
        assert all(w == walked[0] for w in walked)
        taken = np.flatnonzero((sums <= multiindex.reach(a, b, counts, quota)) & (counts > 0))
        assert set(taken.tolist()) == set(walked[0])
    assert multiindex.reach(a, b, np.zeros(1200, np.int64), 5) == -np.inf


def test_scan_equals_brute_force_in_any_tiles(monkeypatch):
    random = np.random.default_rng(7)
    x = random.standard_normal((900, 6)).astype(np.float32)
    # Equal directions of other lengths tie; of the third entry six ids are known.
    x[300:340] = 2 * x[:40]
    ids = [[i] if i != 3 else [3, 1000, 1001, 1002, 1003, 1004] for i in range(len(x))]
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cells = multiindex.Cells(unit[:4, :3], unit[4:9, 3:])
    bucket = cells.cell(unit)
    counts = np.bincount(bucket, minlength=20)
    order = np.argsort(bucket, kind="stable")
    table = pa.table({"v": pa.array(x[order].tolist(), pa.list_(pa.float32())), "ids": [ids[i] for i in order], "bucket": bucket[order]})
    q = np.concatenate([x[:50], random.standard_normal((50, 6)).astype(np.float32)])
    a, b = cells.distances(q / np.linalg.norm(q.astype(float), axis=1, keepdims=True))
    taken = [multiindex.nearest_cells(a[i], b[i], counts, 400) for i in range(100)]
    far = np.array([multiindex.reach(a[i], b[i], counts, 400) for i in range(100)])
    want = []
    for i in range(100):
        score = np.round(unit @ (q[i] / np.linalg.norm(q[i].astype(float))), 12)
        rows = [(-score[e], j) for e in range(len(x)) if bucket[e] in taken[i] for j in ids[e]]
        want.append([j for _, j in sorted(rows)[:6]])
    for numbers, rows in ((1 << 21, 900), (200, 900), (30, 37)):
        monkeypatch.setattr(multiindex, "TILE_NUMBERS", numbers)
        found = defaultdict(list)
        for batch in multiindex.scan(table.to_batches(rows), multiindex.Searches(np.arange(100), q, far), cells, 6):
            for r in batch.to_pylist():
                found[r["search"]].append((-round(r["score"], 12), r["id"]))
        assert [[j for _, j in sorted(found[i])] for i in range(100)] == want


def test_rounds_of_searches_change_nothing(spark, monkeypatch):
    df = vectors(spark, odd_vectors()).cache()
    whole = multiindex.nearest(df, F.col("vec_id") % 50 == 0).collect()
    monkeypatch.setattr(multiindex, "SEARCH_BYTES", 200)
    assert sorted(multiindex.nearest(df, F.col("vec_id") % 50 == 0).collect()) == sorted(whole)


def test_memory_does_not_grow_with_searches_times_cells(spark, monkeypatch):
    # Workers of their own: no other test's memory counts.
    monkeypatch.setitem(spark.sparkContext.environment, "COUPONMILL_TEST", "memory")
    x = np.random.default_rng(9).standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = multiindex.nearest(df, F.lit(True)).collect()

    def peak(batches):
        for _ in batches:
            pass
        time.sleep(0.1)
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], names=["kb"])

    peaks = [r["kb"] for r in spark.range(0, 64, 1, 64).mapInArrow(peak, "kb long").collect()]
    assert len(found) == 15_000 and max(peaks) < 700_000


def test_layout_deals_large_buckets_and_joins_small_ones():
    layout = visits.Layout.of(np.array([3, 4, 25, 0, 2, 9, 1]), block_rows=10)
    assert layout.parts.tolist() == [1, 1, 3, 1, 1, 1, 1]
    assert layout.first.tolist() == [0, 0, 1, 4, 4, 5, 5]
    blocks = layout.block_of(np.full(1000, 2), np.arange(1000))
    assert set(blocks.tolist()) == {1, 2, 3} and np.bincount(blocks).max() < 450
    assert {n: b.tolist() for n, b in layout.blocks_of(np.array([2, 0, 4]))} == {0: [0], 1: [2], 2: [2], 3: [2], 4: [4]}


def mined(rows, anchors, scale=256):
    whole = [(i, np.floor(scale * v).astype(int), label) for i, v, label in usable(rows, True) if label is not None]
    out = set()
    for i, v, label in whole:
        if not anchors(i):
            continue
        scored = sorted({(-int(v @ w), j, m) for j, w, m in whole if len(w) == len(v)})
        mates = list(dict.fromkeys((s, j) for s, j, m in scored if m == label and j != i))[:5]
        for s, mate in mates:
            inside = [(t, j) for t, j, m in scored if m != label and -30 * s <= -100 * t <= -90 * s][:10]
            out |= {(i, mate, n + 1, j, -s, -t) for n, (t, j) in enumerate(inside)}
    return out


def test_mining_equals_brute_force(spark):
    rows = odd_vectors()
    p = hyperplanes.Mining(ways=4, leaf_rows=5)
    got = hyperplanes.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0, p=p).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert {tuple(r[n] for n in names) for r in got} == mined(rows, lambda i: i % 50 == 0) and len(got) > 100


def test_ranges_eliminate_far_leaves_and_lose_nothing(spark):
    random = np.random.default_rng(8)
    centre = 400 * random.standard_normal((20, 6))
    x = np.rint(centre[random.integers(0, 20, 3000)] + 5 * random.standard_normal((3000, 6)))
    length = float((x**2).sum(axis=1).max())
    p = hyperplanes.Mining(ways=4, leaf_rows=50)
    tree = hyperplanes.plant(x[:1000], length, p, len(x))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    tree = hyperplanes.with_ranges(tree, df, "v")
    leaf = tree.leaf(x, tree.extra(x))
    q = x[:40]
    score = q @ x.T
    low = np.sort(score, axis=1)[:, -30][:, None]
    reached = tree.reached(q, *hyperplanes.annulus(length, q, low, np.full_like(low, hyperplanes.GREATEST)))
    wanted = np.zeros_like(reached)
    for i in range(len(q)):
        wanted[i, leaf[score[i] >= low[i]]] = True
    assert not (wanted & ~reached).any()
    assert reached.mean() < 0.5


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audited(rows, p):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(brute.FOLD))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        holders, own = Counter(), defaultdict(Counter)
        for g, source, words in docs:
            if g == lang:
                holders.update(set(words))
                own[source].update(words)
        kept = [t for t, n in holders.items() if n >= p.least_documents]
        whole = sum(own.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept}

        of_lang, of = shares(whole), {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(of_lang[t] - of[s][t], t.encode(), t) for t in kept if own[s][t] and of[s][t] > of_lang[t]]
            out += [(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(terms)[: p.top_terms])]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    random = np.random.default_rng(4)
    words = ["Ab", "ab", "c9d", "été", "中文", "z_z", "Ärger", "ärger", "w" * 300, *(f"t{chr(97 + i)}" for i in range(20))]
    rows = [
        (("en", "de", None)[i % 3], f"s{i % 7}" if i % 11 else None, " ".join(random.choice(words[: 5 + 3 * (i % 7)], i % 40)))
        for i in range(300)
    ]
    rows += [("en", "empty", t) for t in (None, "", "123 !!", brute.PROSE * 400)] + [("xx", "one", "a b"), ("yy", "a", ""), ("yy", "b", None)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, source string, text string, gid int, term string")
    for p in (divergence.Audit(least_documents=5), divergence.Audit(least_documents=5, top_terms=3, group_block=2, term_block=4, held_counts=7)):
        got = divergence.audit(df, p=p)
        names = ("lang", "source", "part", "item", "value", "rank")
        assert sorted(tuple(r[n] for n in names) for r in got.collect()) == audited(rows, p)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_hold_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 1_000_000)], "n long, total long, terms long")
    p = divergence.Audit()
    (row,) = df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"), p).alias("s")).collect()
    assert row["s"] == 1 + 10**9 * (9_000_000_000_000_000 + 5) // (9_100_000_000_000_000 + 5_000_000)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = (brute.PROSE * 50).encode()
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 37)
    assert divergence.terms_of(text) == whole and whole[b"the"] == 150 and b"" not in whole
