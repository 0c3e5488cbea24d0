"""Quality, decontamination, Jaccard join, line dedup and licenses against brute force."""

import sys
import textwrap
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from couponmill.llm import catalog, decontaminate, jaccard, licenses, linededup, quality  # noqa: E402
from couponmill.llm.blocks import forest  # noqa: E402
from couponmill.llm.components import components  # noqa: E402
from couponmill.llm.words import ngrams, utf8, words  # noqa: E402
from couponmill.session import stage  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return [r["doc_id"] for r in rows], [r["text"] for r in rows]


def test_words_are_the_contract_pattern(documents):
    texts = [*brute.ODD_TEXTS, *documents[1]]
    value, index = words(*utf8(pa.array(texts, pa.string())))
    expected = [brute.words(t) for t in texts]
    assert list(np.diff(index)) == [len(w) for w in expected]
    number = dict(zip((w for ws in expected for w in ws), value))
    assert [number[w] for ws in expected for w in ws] == list(value)
    assert len(set(number.values())) == len(number)
    runs, at = ngrams(value, index, 5)
    assert [len(set(runs[a:b])) for a, b in zip(at[:-1], at[1:])] == [len(s) for s in brute.ngram_sets(texts)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert list(forest(np.arange(5), (np.array([3, 1]), np.array([4, 3])))) == [0, 1, 2, 1, 1]


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_settled_links_are_not_written_again(spark, monkeypatch, capsys, limit):
    """Stars need no step, and the steps of few links broadcast their minima instead of shuffling."""
    from couponmill.llm import components as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", limit)
    written = []

    def put(df):
        df.explain("extended")
        written.append(capsys.readouterr().out)
        return stage(df)

    star = [(i, 1) for i in range(2, 40)] + [(i, 50) for i in range(51, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(star, "a long, b long"), put).collect()))
    assert got == {i: 1 if i < 40 else 50 for i in [*range(1, 40), *range(50, 60)]}
    assert len(written) == 1
    chain = spark.range(30).selectExpr("id AS a", "id + 1 AS b")
    assert dict(map(tuple, components(chain, put).collect())) == dict.fromkeys(range(31), 0)
    assert all(("strategy=broadcast" in plan) == (limit > 1) for plan in written[2:])


def test_jaccard_join_equals_brute_force(spark, sf_dir, documents):
    ids, texts = documents
    links, root = brute.jaccard_links(texts)
    got = {r["doc_id"]: r for r in catalog.QUERIES["op8_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert [got[i]["n_links"] for i in ids] == links
    assert [got[i]["class_id"] for i in ids] == [ids[r] for r in root]


def test_jaccard_blocks_lose_no_link(spark):
    """A group of near copies larger than a block, and its exact copies."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{k}" if j == k % 190 else w for j, w in enumerate(base)) for k in range(60)]
    texts += texts[:10] + ["own words of another text entirely"]
    links, root = brute.jaccard_links(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(df, p=jaccard.Forest(block_rows=16)).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == root


def test_jaccard_of_odd_and_empty_tables(spark):
    df = brute.odd_documents(spark)
    rows = jaccard.jaccard_join(df).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["n_links"] for i in range(9)] == [0] * 9
    # The prose: two ids, one repeated row and one row without an id.
    assert {r["class_id"] for r in rows if r["n_links"] == 3} == {9} and got[9]["n_copies"] == 3
    assert jaccard.jaccard_join(df.limit(0)).count() == 0
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 3


def test_shortening_ends_at_the_recall():
    p = jaccard.Forest()
    assert p.prefix < p.depth and 1 - (1 - 0.8**p.prefix) ** p.trees >= p.recall
    with pytest.raises(ValueError):
        jaccard.Forest(trees=1).prefix


def test_climbing_starts_at_the_longest_prefixes(monkeypatch):
    """Four labels of one trie: equal, shorter in common, far signatures, and another node."""
    p = jaccard.Forest(trees=1, depth=4, recall=0.5)
    assert p.prefix == 3
    signature = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 9], [1, 7, 3, 4]], np.uint32)
    trie, starts = np.zeros(4, np.int64), np.zeros(1, np.int64)
    assert list(jaccard.climb(signature, trie, starts, p)) == [0, 0, 0, 3]
    # Rows of one cluster are not compared again at shorter prefixes.
    monkeypatch.setattr(jaccard, "_join_clusters", None)
    assert list(jaccard.climb(signature, trie, starts, p)) == [0, 0, 0, 3]
    monkeypatch.undo()
    far = jaccard.Forest(trees=8, depth=4, recall=0.5)
    assert far.floor > 0.35
    signature = np.random.default_rng(1).integers(0, 9999, (3, 32)).astype(np.uint32)
    signature[:, :4] = [5, 6, 7, 8]
    signature[2, 4:] = signature[0, 4:]
    # First and last are alike; the one between shares the label alone.
    assert list(jaccard.climb(signature, trie[:3], starts, far)) == [0, 1, 0]


@pytest.mark.parametrize("block_rows", [8, 512])
def test_clusters_in_large_trie_nodes_are_all_found(spark, block_rows):
    """Classes of one label in every trie, in three clusters that only whole signatures tell apart."""
    p = jaccard.Forest(block_rows=block_rows)
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 32, (3, p.trees * p.depth), dtype=np.uint32)
    base[:, :6] = base[0, :6]
    rows = []
    for i in range(90):
        own = base[i % 3].copy()
        own[6 + i % 114] = i
        rows.append((i, bytearray(own.tobytes())))
    classes = spark.createDataFrame(rows, "node long, signature binary")
    work = jaccard.Scratch(spark)
    got = {r["node"]: r["root"] for r in jaccard._candidates(classes, p, work).collect()}
    assert got == {i: i % 3 for i in range(90)}
    # Without what the pieces found, the blocks alone join every cluster.
    large = classes.select("node", F.lit(1).cast("long").alias("bucket"))
    nothing = spark.createDataFrame([], "node long, root long")
    links = jaccard._between(classes, large, nothing, p, work)
    assert {r["node"]: r["root"] for r in components(links).collect()} == got
    # Members of the largest cluster meet the others only.
    known = spark.createDataFrame([(i, i % 3) for i in range(90)], "node long, root long")
    assert jaccard._between(classes, large, known, p, work).count() == 0


@pytest.mark.parametrize("changed", [1, 2, 4])
def test_measured_recall_of_the_forest(spark, changed):
    """300 pairs each, of similarities from just above the threshold up."""
    own, texts = 5, []
    length = {1: 50, 2: 94, 4: 184}[changed]
    for k in range(300):
        base = [f"p{k}w{i}" for i in range(length)]
        other = list(base)
        for c in range(changed):
            other[own + c * (length - 2 * own) // changed] += "x"
        texts += [" ".join(base), " ".join(other)]
    links, root = brute.jaccard_links(texts)
    assert links == [1] * 600
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[i]["n_links"] for i in range(600)) / 600
    assert found >= 0.99
    assert all(got[i]["class_id"] in (i, root[i]) for i in range(600))


def test_contamination_equals_brute_force(spark, sf_dir, documents):
    ids, texts = documents
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "the of"), (901, "the of"), (902, None), (903, ""), (None, "seldom seen short item"), (1, items[1][1])]
    texts = [*texts, "Seldom seen SHORT item!", items[0][1], "x " + items[0][1] + " " + items[2][1], None]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    rows = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r["doc_id"]: r for r in rows}
    expected = brute.contamination(texts, [("null" if n is None else n, t) for n, t in items])
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in range(len(texts))] == expected
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in rows)
    assert got[len(texts) - 3]["longest"] >= len(brute.words(items[0][1]))


def test_contamination_in_several_blocks(spark, sf_dir, documents, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ["doc_id", "n_words", "n_hit", "items", "longest", "contaminated"]
    one = sorted(map(str, decontaminate.contamination(docs, items).select(columns).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1_500)
    assert sorted(map(str, decontaminate.contamination(docs, items).select(columns).collect())) == one


def test_contamination_of_odd_and_empty_tables(spark):
    df = brute.odd_documents(spark)
    items = spark.createDataFrame([(1, brute.PROSE)], "item_id long, text string")
    assert decontaminate.clean(df, items).columns == df.columns
    assert decontaminate.clean(df, items).count() == df.count() - 5
    assert decontaminate.clean(df, items.limit(0)).count() == df.count()
    assert decontaminate.contamination(df.limit(0), items).count() == 0


def test_quality_on_held_out_labels(spark, sf_dir):
    """Labels are not used in training; noise in them allows a few errors."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = catalog.QUERIES["op2_quality_classifier"](spark, sf_dir).join(labels, "doc_id").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in rows]
    assert sum(right) / len(right) > 0.97
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.98


def test_quality_of_odd_and_empty_tables(spark, sf_dir):
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert ((model.votes.accuracy() > 0.5) & (model.votes.accuracy() <= 1)).all()
    df = brute.odd_documents(spark)
    rows = quality.classify(df, model).collect()
    assert len(rows) == df.count() and all(r["kept"] for r in rows if not r["text"])
    assert len({r["score"] for r in rows if r["text"] == brute.PROSE}) == 1
    assert quality.classify(df.limit(0)).count() == 0
    assert quality.classify(df).count() == df.count()


def test_expectation_maximisation_finds_the_bad_class():
    random = np.random.default_rng(1)
    bad = random.random(5000) < 0.2
    own = np.array([label.vote for label in quality.LABELLERS])
    hits = random.random((5000, len(own)))
    votes = np.where(hits < np.where((own == quality.BAD)[None] == bad[:, None], 0.7, 0.05), own, quality.NONE)
    pattern, count = np.unique(quality.patterns(votes), return_counts=True)
    model = quality.expectation_maximisation(pattern, count)
    assert abs(model.prior - 0.8) < 0.03
    assert ((model.posterior(quality.patterns(votes)) < 0.5) == bad).mean() > 0.98


@pytest.mark.parametrize("limit, pages", [(linededup.BROADCAST_LINES, 100_000), (-1, 4)])
def test_line_dedup_cases(spark, monkeypatch, limit, pages):
    """Also with the lists joined by shuffle and salted."""
    monkeypatch.setattr(linededup, "BROADCAST_LINES", limit)
    monkeypatch.setattr(linededup, "PAGES_PER_SALT", pages)
    rows = [(i, "a", f"menu\nbody {i}\n\n menu ") for i in range(10)] + [(i, "b", f"menu\nother {i}") for i in range(10, 13)]
    rows += [(20, None, "menu"), (21, None, None), (22, "a", ""), (0, "a", "menu\nbody 0\n\n menu ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, lines_dropped int")
    got = sorted((r["doc_id"], r["text"] or "", r["lines_dropped"]) for r in linededup.drop_boilerplate(df).collect())
    # The row that repeats is two of twelve pages, so its own line goes too.
    expected = [(i, f"body {i}\n", 2) for i in range(1, 10)] + [(i, f"other {i}", 1) for i in range(10, 13)]
    assert got == sorted([*expected, (0, "", 3), (0, "", 3), (20, "menu", 0), (21, "", 0), (22, "", 0)])
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0
    shares = {(r["source"], r["total"], r["pages"]) for r in linededup.line_shares(df).where("pages > 5").collect()}
    assert shares == {("a", 12, 11)}


def test_line_dedup_goes_by_the_ratio_alone(spark):
    """Hosts of one page, of four and of forty; internal names as columns of the input."""
    rows = [(0, "one", "menu\nx"), (1, "one-copy", "a\nb"), (1, "one-copy", "a\nb")]
    rows += [(10 + i, "four", f"menu\nbody {i}") for i in range(4)]
    # On forty pages: 4 pages are a tenth and stay, 5 are more and go.
    rows += [(20 + i, "forty", f"page {i}" + ("\ntenth" if i < 4 else "") + ("\nmore" if i % 8 == 0 else "")) for i in range(40)]
    df = spark.createDataFrame([(*r, "h", "b", 7) for r in rows], "doc_id long, source string, text string, _host string, _bad string, total int")
    got = linededup.drop_boilerplate(df)
    assert got.columns == [*df.columns, "lines_dropped"]
    text = {(r["source"], r["doc_id"]): (r["text"], r["lines_dropped"], r["_host"], r["_bad"], r["total"]) for r in got.collect()}
    kept = {k: (v[0], v[1]) for k, v in text.items()}
    assert all(v[2:] == ("h", "b", 7) for v in text.values())
    assert kept["one", 0] == ("menu\nx", 0) and kept["one-copy", 1] == ("", 2)
    assert all(kept["four", 10 + i] == (f"body {i}", 1) for i in range(4))
    for i in range(40):
        want = f"page {i}" + ("\ntenth" if i < 4 else "")
        assert kept["forty", 20 + i] == (want, int(i % 8 == 0))


def test_line_dedup_of_odd_rows(spark):
    df = brute.odd_documents(spark)
    assert linededup.drop_boilerplate(df).drop("lines_dropped").columns == df.columns
    assert linededup.drop_boilerplate(df).count() == df.count()


@pytest.fixture(scope="module")
def license_model(spark, sf_dir):
    return licenses.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def test_every_template_is_predicted_and_confirmed(spark, license_model):
    """Also short identifiers, single clauses, and the share of word pairs against plain Python."""
    texts = [t for _, t in licenses.TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df, model=license_model).collect()}
    assert [rows[i]["licenses"] for i in range(len(texts))] == [f for f, _ in licenses.TEMPLATES]
    for i, text in enumerate(texts):
        own = set(licenses._template_pairs(text))
        shares = [len(own & set(p)) / len(p) for p in map(licenses._template_pairs, texts)]
        assert rows[i]["best_similarity"] == pytest.approx(max(shares), abs=1e-6)
    assert licenses.LEAST_SURE < license_model.threshold < 1


def test_licenses(spark, sf_dir, license_model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = license_model
    added = [
        (-1, "Some text.\nReleased under the MIT License.\nMore."), (-2, "All rights reserved."), (-3, None), (-4, ""),
        (-5, "Licensed under the Apache License, version 2.0\nThis work is licensed under the GNU General Public License, version 3."),
        (-6, "The driving license of the author was lost in the sea."), (-6, "x " * 20_000),
    ]
    rows = licenses.scan(docs.union(spark.createDataFrame(added, docs.schema)), model=model).collect()
    assert len(rows) == docs.count() + len(added)
    got = {r["doc_id"]: r["licenses"] for r in rows}
    assert [got[-i] for i in range(1, 7)] == ["mit", "all-rights-reserved", "", "", "apache-2.0,gpl-3.0", ""]
    noted = docs.where(F.col("text").rlike("(Apache|MIT|General Public) License|CC BY-NC|All rights reserved"))
    assert {r["doc_id"] for r in noted.collect()} == {k for k, v in got.items() if v and k >= 0}
    assert licenses.scan(docs.limit(0), model=model).count() == 0


def test_the_license_classifier_counts_every_piece(spark):
    """More different lines than any sample held, equal counts in one row, notices and empty lines left out."""
    lines = [(f"line{i} of a granted copy\n\nline{i} was lost" if i % 3 else f"line{i} is at sea\n",) for i in range(9_000)]
    lines += [("Released under the MIT License.\nThe software is old.",), (None,), ("",), (" \n--",)]
    docs = spark.createDataFrame(lines, "text string")
    got = {tuple(r["terms"]): r["n"] for r in licenses.background(*licenses.telling(docs, "text")).collect()}
    assert got == {(): 6_000 + 3_000, ("copy", "granted"): 6_000, ("software", "software is", "the software"): 1}


def test_wrapped_license_notices(spark, license_model):
    """Notices broken into lines of any width, with comment signs, alone or between other lines."""
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy and modify.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    }
    texts, expected = [], []
    for family, notice in notices.items():
        for width in (20, 45, 72):
            lines = textwrap.wrap(notice, width)
            texts += ["\n".join(lines), "import os\n\n" + "\n".join(f" * {x}" for x in lines) + "\n *\n * " + brute.PROSE, brute.PROSE + "\n" + "\n".join(lines) + "\n" + brute.PROSE]
            expected += [family] * 3
    texts += [f"{brute.PROSE * 20}{notices['bsd']} {brute.PROSE * 20}", "\n".join(textwrap.wrap(brute.PROSE * 9, 70))]
    expected += ["bsd", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, model=license_model).collect()}
    assert [got[i]["licenses"] for i in range(len(texts))] == expected
    assert [got[i]["n_confirmed"] for i in range(len(texts))] == [int(f != "") for f in expected]


def test_neighbouring_licenses_are_told_apart(spark, license_model):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"), ("Licensed under CC BY 4.0.", "cc-by-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
        (gnu.format("General Public License", 2), "gpl-2"), (gnu.format("Lesser General Public License", 2.1), "lgpl-2.1"),
        (gnu.format("Affero General Public License", 3), "agpl-3"), (gnu.format("General Public License", 3), "gpl-3.0"),
        *((text, "") for text in licenses.FOREIGN),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df, model=license_model).collect()}
    assert [(cases[i][0], got[i]) for i in got] == [cases[i] for i in got]


def test_copies_of_one_junk_text_are_rejected(spark):
    """Few different texts in many copies still train the scorer."""
    junk = "BUY NOW!!! $$$ ### CHEAP!!! ||| WIN WIN WIN!!! $$$ %%% BUY BUY NOW!!! ### | | | CLICK!!! $$$"
    model = quality.fit(spark.range(20_000).select(F.lit(junk).alias("text")))
    assert model.votes.prior < 0.5 and model.weights.any()
    df = spark.createDataFrame([(junk,), (brute.PROSE,)], "text string")
    assert {r["text"]: r["kept"] for r in quality.classify(df, model).collect()}[junk] is False


def test_signs_and_capitals_beyond_ascii():
    """Characters are classed by their Unicode category, so stars are signs and Cyrillic capitals are capitals."""
    names = [label.name for label in quality.LABELLERS]
    texts = [
        "★ ☆ ■ □ ▲ word word word word word ★ ☆ ■ □ ▲ ★ ☆ ■ □ ▲", "КУПИ СЕЙЧАС ДЕШЕВО ТОЛЬКО СЕГОДНЯ", "� � � a b c d e � � �",
        "Летом мы плыли по реке, и вечером долго смотрели на огни.", "Été naïve, où l’œuvre « française » coûte peu.", None, "",
    ]
    r = quality.Reading.of(pa.array(texts, pa.string()))
    assert np.diff(r.offsets).tolist() == [len(t or "") for t in texts]
    cast = [{names[j] for j in np.flatnonzero(row != quality.NONE)} for row in quality.votes(r)]
    assert "signs" in cast[0] and "capitals" in cast[1] and "signs" in cast[2]
    for i in (3, 4):
        assert not {"signs", "capitals", "not_letters"} & cast[i] and "varied" in cast[i]


def longest_matches(text, items, window=13):
    """Longest match from every word of a text that starts a window of an item or a whole shorter one."""
    w, out = brute.words(text), {}
    for name, item in items:
        v = brute.words(item)
        n = min(window, len(v))
        for i in range(len(w)):
            for j in range(len(v) if n else 0):
                k = 0
                while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                    k += 1
                if k >= n and (n == window or (j == 0 and k == n)):
                    out[i] = max(out.get(i, 0), k)
    return out


def test_longest_matches_equal_brute_force(spark):
    """Repeated words, items inside items, and matches that follow each other without being one."""
    random = np.random.default_rng(2)
    run = [f"w{i}" for i in range(12)]
    items = [
        (1, "aa " * 13), (2, " ".join(["a", *run, "q", *run, "b"])), (3, "so " * 20 + "far"), (4, " ".join(run + run[:3])),
        (5, "two words"), (6, " ".join(random.choice(["x", "y", "z"], 60))), (7, " ".join(random.choice(["x", "y"], 80))), (8, None),
    ]
    texts = ["aa " * 100, " ".join(["a", *run, "b"]), "so " * 33 + "far", " ".join(run + run), "two words two words", None, ""]
    texts += [" ".join(random.choice(["x", "y", "z", "u"], 200, p=[0.4, 0.4, 0.15, 0.05])) for _ in range(12)]
    texts += [f"u {items[5][1]} {items[6][1]} {items[5][1]} v", " ".join(items[6][1].split()[7:50])]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, _row int, words int, row int")
    out = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns[:4] == ["doc_id", "text", "_row", "words"] and out.columns[4] == "row"
    rows = {r["doc_id"]: r for r in out.collect()}
    named = dict((str(n), brute.words(t)) for n, t in items)
    for i, text in enumerate(texts):
        found = longest_matches(text, items)
        assert rows[i]["longest"] == max(found.values(), default=0)
        w = brute.words(text)
        for s in rows[i]["spans"]:
            part, item = w[s["start"] : s["start"] + s["length"]], named[s["item"]]
            assert any(item[j : j + len(part)] == part for j in range(len(item)))
        covered = {k for s in rows[i]["spans"] for k in range(s["start"], s["start"] + s["length"])}
        assert covered == {k for p, n in found.items() for k in range(p, p + n)} and len(covered) == rows[i]["n_hit"]
    assert rows[0]["longest"] == 13 and rows[1]["longest"] == 13
