"""License scan: a trained paragraph classifier and a comparison with templates.

A paragraph is a run of lines between blank ones.  Its lines are judged one by one, and
a paragraph that as a whole holds enough of a template is also judged in overlapping
stretches of words, so that a notice counts however its lines are broken.

These pieces become sparse counts of the templates' word 1- and 2-grams, stop words only in
the latter.  A multinomial logistic regression with an elastic net is trained on altered copies
of license templates and on all pieces of the corpus as the class ``none``, equal counts being
one weighted row.  The family is the likeliest one; how sure the classifier must be of it is
calibrated on all pieces of the corpus, on
notices of foreign families and on further copies.  A template confirms the prediction if the
piece shares enough of its word pairs and has the words that tell the family from its neighbours.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from couponmill.session import stage

# Neighbours of the GNU and Creative Commons families.
_GNU = (("gpl", "", "2"), ("lgpl", "Lesser", "2.1"), ("lgpl", "Lesser", "3"), ("agpl", "Affero", "3"))
_CC = (
    ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)

# Families and their public short identifiers.
_SPDX = (
    ("apache-2.0", "Apache-2.0"), ("mit", "MIT"), ("gpl-3.0", "GPL-3.0-only"), ("gpl-2", "GPL-2.0-only"), ("bsd", "BSD-3-Clause"),
    ("bsd", "BSD-2-Clause"), ("isc", "ISC"), ("cc-by-4.0", "CC-BY-4.0"), ("cc-by-nc-4.0", "CC-BY-NC-4.0"),
)

# Common notices of license families, public texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Copyright by the author. All rights reserved."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("mit", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *((family, f"SPDX-License-Identifier: {name}") for family, name in _SPDX),
    *((f"{name}-{v}", f"This work is licensed under the GNU {title} General Public License, version {v}.") for name, title, v in _GNU),
    *((f"{name}-{v}", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} General Public License as published by the Free Software Foundation, either version {v} of the License, or any later version.") for name, title, v in _GNU),
    *((f"cc-{k}-{v}", f"Licensed under CC {k.upper()} {v}.") for k, _ in _CC for v in ("3.0", "4.0") if (k, v) != ("by-nc", "4.0")),
    *((f"cc-{k}-{v}", f"This work is licensed under a Creative Commons {title} {v} {kind} License.") for k, title in _CC for v, kind in (("3.0", "Unported"), ("4.0", "International")) if (k, v) != ("by-nc", "4.0")),
)
FAMILIES = ("none", *sorted({family for family, _ in TEMPLATES}))



def _gnu(title: str, number: str) -> str:
    return rf"\bgnu {title}general public license(?: (?!gnu\b|version\b|v\d)\S+){{0,8}}? (?:version|v) ?{number}(?: 0)?\b(?! [1-9])"


def _cc(kind: str, title: str, version: str) -> str:
    version = version.replace(".", " ")
    return rf"\bcc {kind.replace('-', ' ')} {version}\b|\bcreative commons {title.lower().replace('-', ' ')} {version}\b"


# Words that tell a family from its neighbours, as patterns of the words joined by blanks.
MARKS = {
    "apache-2.0": r"\bapache license version 2 0\b|\bdistributed under the license is distributed on an as is basis\b",
    "apache-1.1": r"\bapache license version 1 1\b",
    "mit": r"\bthe mit license\b|\bany person obtaining a copy of this software\b.*\bdeal in the software\b",
    "isc": r"\bthe isc license\b|\bpermission to use copy modify and(?: or)? distribute this software\b",
    "bsd": r"\bredistribution and use in source and binary forms\b",
    "all-rights-reserved": r"(?<!\bnot )\ball rights reserved\b",
    "gpl-3.0": _gnu("", "3"),
    **{f"{name}-{v}": _gnu(title.lower() + " " if title else "", v.replace(".", " ")) for name, title, v in _GNU},
    **{f"cc-{k}-{v}": _cc(k, title, v) for k, title in _CC for v in ("3.0", "4.0")},
}
MARKS["mit"] += r"|\bwarranties of merchantability fitness for a particular purpose and noninfringement\b"
MARKS["bsd"] += r"|\ba bsd style license\b"
for _family, _name in _SPDX:
    MARKS[_family] += r"|\bspdx license identifier " + re.sub(r"[^a-z0-9]+", " ", _name.lower()).replace(" only", "(?: only)?") + r"\b(?! \d)"
# Notices of families without a template, which nothing may confirm.
FOREIGN = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Licensed under the Apache License, Version 3.0.",
    "This work is licensed under the GNU General Public License, version 4.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 2.5 Generic License.",
    "Licensed under CC BY-NC 2.0.",
    "Released under the Artistic License.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",
    "Redistribution and use in source and compiled forms, with or without modification, are permitted provided that the following conditions are met.",
    "Copyright by the author. Some rights reserved.",
)

# Altered copies of each template for training.
COPIES = 40
# Altered copies that all pieces of the corpus together weigh as much as in training.
BACKGROUND = 2_000
# Share of the corpus' pieces that may pass as a license.
FALSE_ALARMS = 0.001
# The threshold is never below this, however clear the calibration pieces are.
LEAST_SURE = 0.3
# Least share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6


NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Lines without a word, such as bare comment signs, end a paragraph.
BLANK_LINES = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Neighbouring words joined by a blank."""
    return F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


@dataclass(frozen=True)
class LicenseModel:
    terms: CountVectorizerModel
    regression: LogisticRegressionModel
    threshold: float


def _templates(spark) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "id int, family string, text string")


def _template_pairs(text: str) -> list[str]:
    """Distinct word pairs of a template, as ``pairs(words(text))``."""
    w = [x for x in re.split(NO_WORD, text.lower()) if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _known() -> Column:
    """Family and distinct word pairs of every template, as constants."""
    return F.array(*[F.struct(F.lit(f).alias("family"), F.lit(_template_pairs(t)).alias("pairs")) for f, t in TEMPLATES])


def _confirmable(w: Column, own: Column) -> Column:
    """Families with their telling words among ``w`` and enough of a template among the pairs ``own``."""
    near = F.array_distinct(F.transform(F.filter(_known(), lambda t: _share(own, t) >= CONFIRM), lambda t: t["family"]))
    joined = F.array_join(w, " ")
    told = F.array_compact(F.array(*[F.when(joined.rlike(MARKS[f]), F.lit(f)) for f in FAMILIES[1:]]))
    return F.when(F.size(near) > 0, F.array_intersect(near, told)).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _share(own: Column, template: Column) -> Column:
    """Share of a template's word pairs among ``own``."""
    return F.size(F.array_intersect(own, template["pairs"])) / F.size(template["pairs"])


def _steps() -> list[int]:
    """Doubling numbers of words, the last not below the longest template."""
    longest = max(len(t.split()) for _, t in TEMPLATES)
    steps = [6]
    while steps[-1] < longest:
        steps.append(2 * steps[-1])
    return steps


def stretches(w: Column) -> Column:
    """Overlapping runs of words: every run of up to ``step`` words lies in one of twice that many."""

    def cut(step: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - step - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda i: F.slice(w, i + 1, F.lit(2 * step)))

    return F.flatten(F.array(*[cut(step) for step in _steps()]))


def _known_pairs(w: Column) -> Column:
    """The template pairs among the neighbouring words, in order; others are never built."""
    known = sorted({p for _, t in TEMPLATES for p in _template_pairs(t)})
    left, right = ({p.split(" ")[i] for p in known} for i in (0, 1))
    both = F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.when(a.isin(sorted(left)) & b.isin(sorted(right)), F.concat_ws(" ", a, b)),
    )
    return F.filter(both, lambda p: p.isNotNull() & p.isin(known))


def _reaches(own: Column) -> Column:
    """Whether the template pairs ``own`` are enough of some template; otherwise no part of them is."""
    # Most paragraphs share too few pairs with all templates together for any of them.
    fewest = min(math.ceil(CONFIRM * len(_template_pairs(t))) for _, t in TEMPLATES)
    return (F.size(own) >= fewest) & F.exists(_known(), lambda t: _share(own, t) >= CONFIRM)


def pieces(docs: DataFrame, text: str) -> DataFrame:
    """One row per piece of a text: ``_paragraph``, ``_at``, ``words`` and ``is_line``; NULL texts have one piece of NULL words.

    Pieces are the lines, and the stretches of paragraphs that can hold a notice.
    """
    line = lambda w, yes: F.struct(w.alias("words"), F.lit(yes).alias("is_line"))
    more = lambda w: F.when(_let(_known_pairs(w), _reaches), stretches(w)).otherwise(F.array().cast("array<array<string>>"))
    # No word goes beyond its line.
    lines = F.transform(F.split("_text", "\n"), words)
    every = _let(lines, lambda x: F.concat(F.transform(x, lambda w: line(w, True)), F.transform(_let(F.flatten(x), more), lambda w: line(w, False))))
    found = docs.select("*", F.posexplode_outer(F.split(F.col(text), BLANK_LINES)).alias("_paragraph", "_text"))
    found = found.select("*", F.posexplode_outer(every).alias("_at", "_piece"))
    return found.select(*docs.columns, "_paragraph", "_at", "_piece.words", "_piece.is_line")


def vocabulary() -> list[str]:
    """Words, but stop words, and word pairs of the templates; all others count nothing."""
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    single = {x for _, t in TEMPLATES for x in re.split(NO_WORD, t.lower()) if x} - stop
    return sorted(single.union(*(_template_pairs(t) for _, t in TEMPLATES)))


def _terms(w: Column, own: Column) -> Column:
    """Sorted terms of the vocabulary among the words and their known pairs."""
    return F.array_sort(F.concat(F.filter(w, lambda x: x.isin([v for v in vocabulary() if " " not in v])), own))


def telling(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Stored pieces with a term of the vocabulary, and the number of the others that have words.

    Columns are those of ``docs`` but the text, ``_paragraph``, ``is_line``, ``terms``, ``n_pairs``
    and, where they hold enough of a template, ``words``.  The first piece of a text is always there.
    """
    found = pieces(docs, text).drop(text).withColumn("_known", _known_pairs(F.col("words")))
    found = found.withColumn("terms", F.coalesce(_terms(F.col("words"), F.col("_known")), F.array().cast("array<string>")))
    other = Observation()
    found = found.observe(other, F.count_if((F.size("terms") == 0) & (F.size("words") > 0)).alias("n"))
    found = found.where((F.size("terms") > 0) | ((F.coalesce("_paragraph", F.lit(0)) == 0) & (F.coalesce("_at", F.lit(0)) == 0)))
    kept = stage(
        found.select(
            *[c for c in docs.columns if c != text], "_paragraph", "is_line", "terms",
            # Without a known pair it only matters whether there is any.
            F.when(F.size("_known") > 0, F.size(F.array_distinct(pairs(F.col("words"))))).otherwise(F.greatest(F.size("words") - 1, F.lit(0))).alias("n_pairs"),
            F.when(_reaches(F.col("_known")), F.col("words")).alias("words"),
        )
    )
    return kept, other.get["n"]


def background(found: DataFrame, others: int) -> DataFrame:
    """``terms`` and the number ``n`` of all pieces of the corpus that have them, but of those with a notice in them."""
    notice = F.size(_confirmable(F.col("words"), F.col("terms"))) > 0
    # Every word stands in one line; stretches repeat them and cut notices, whose parts are no background.
    rest = found.where(F.col("is_line") & (F.size("terms") > 0)).where(F.col("words").isNull() | ~notice)
    empty = found.sparkSession.createDataFrame([([], others)], "terms array<string>, n long").where("n > 0")
    return rest.groupBy("terms").agg(F.count("*").alias("n")).union(empty)


def _likeliest() -> Column:
    """The likeliest family of a scored piece and its probability."""
    p = vector_to_array("probability")
    return F.array_max(F.array(*[F.struct(p[i].alias("p"), F.lit(f).alias("family")) for i, f in enumerate(FAMILIES) if i]))


def fit(docs: DataFrame, text: str = "text") -> LicenseModel:
    """Train on the templates and on all pieces of the corpus."""
    return _fitted(*telling(docs.select(text), text))


def _fitted(found: DataFrame, others: int) -> LicenseModel:
    spark = found.sparkSession
    # A word is dropped from an altered copy one time in ten, and strange words stand around it.
    kept = F.filter(
        F.transform(F.col("words"), lambda w, i: F.when(F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(10)) > 0, w)),
        lambda w: w.isNotNull(),
    )
    terms = _terms(F.col("words"), _known_pairs(F.col("words"))).alias("terms")
    altered = (
        _templates(spark)
        .select("family", words(F.col("text")).alias("words"), F.explode(F.sequence(F.lit(0), F.lit(COPIES + COPIES // 4 - 1))).alias("copy"))
        .select("family", "copy", F.when(F.col("copy") == 0, F.col("words")).otherwise(kept).alias("words"))
    )
    # A copy without the words that tell its family is no copy of it.
    altered = altered.where(F.array_contains(_confirmable(F.col("words"), pairs(F.col("words"))), F.col("family")))
    altered = stage(altered.select("family", "copy", terms))
    # Pieces with a notice in them are left to the templates.
    corpus = stage(background(found, others))
    total = corpus.agg(F.sum("n")).first()[0] or 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="terms", outputCol="features")
    label = F.array_position(F.lit(list(FAMILIES)), F.col("family")).cast("double") - 1
    weighted = corpus.select(F.lit(0.0).alias("label"), "terms", (F.col("n") * (BACKGROUND / total)).alias("weight"))
    rows = altered.where(F.col("copy") < COPIES).select(label.alias("label"), "terms", F.lit(1.0).alias("weight")).union(weighted)
    regression = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, elasticNetParam=0.5, weightCol="weight").fit(vectors.transform(rows))
    # The corpus, notices of foreign families and altered copies that were held out.
    foreign = spark.createDataFrame([(t,) for t in FOREIGN], "text string").select(words(F.col("text")).alias("words")).select(F.lit("foreign").alias("kind"), terms, F.lit(1).cast("long"))
    judged = corpus.select(F.lit("none").alias("kind"), "terms", "n").union(foreign)
    judged = judged.union(altered.where(F.col("copy") >= COPIES).select(F.lit("copy"), "terms", F.lit(1).cast("long")))
    scored = regression.transform(vectors.transform(judged)).select("kind", F.round(_likeliest()["p"], 4).alias("alarm"), "n")
    # Four decimals, so that few values are counted.
    limit, wrong, right = scored.agg(
        F.percentile(F.when(F.col("kind") == "none", F.col("alarm")), 1 - FALSE_ALARMS, F.col("n")),
        F.max(F.when(F.col("kind") == "foreign", F.col("alarm"))),
        F.percentile_approx(F.when(F.col("kind") == "copy", F.col("alarm")), 0.01, 10_000),
    ).first()
    # As high as the others ask for, but not beyond what altered copies reach.
    return LicenseModel(vectors, regression, max(LEAST_SURE, min(max(limit or 0.0, wrong or 0.0), right or 0.0)))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``licenses``, ``n_confirmed``, ``n_unknown``, ``best_probability``, ``best_similarity``.

    ``licenses`` are the distinct predicted and confirmed families of its paragraphs, sorted and
    comma-joined; ``n_confirmed`` counts every family of every paragraph.  A line is
    unknown if it looks like a license but the classifier is not sure enough or no
    template confirms it, and it is not part of a notice confirmed in its paragraph.
    Documents without any, and NULL and empty texts, have an empty ``licenses`` and zeros.
    Ids that repeat have a row each, other columns are not read, and an empty
    table gives an empty table.
    """
    found, others = telling(docs.select(id_col, text).withColumn("_row", F.monotonically_increasing_id()), text)
    model = model or _fitted(found, others)
    scored = model.regression.transform(model.terms.transform(found))
    # The classifier names the family; what follows only confirms it.
    looks = scored.select(
        id_col, "_row", "_paragraph", "words", "terms", "n_pairs", "is_line", (1 - vector_to_array("probability")[0]).alias("_p"), _likeliest().alias("_best")
    )
    similarity = F.array_max(F.transform(_known(), lambda t: _share(F.col("terms"), t)))
    looks = looks.withColumn("_s", F.when(F.col("_p") >= 0.5, similarity))
    sure = (F.col("_best.p") >= model.threshold) & (F.col("_s") >= CONFIRM)
    none = F.array().cast("array<string>")
    named = F.array_intersect(F.array("_best.family"), _confirmable(F.col("words"), F.col("terms")))
    looks = looks.withColumn("_families", F.when(sure, named).otherwise(none))
    unknown = F.coalesce((F.col("_p") >= 0.5) & (F.size("_families") == 0) & F.col("is_line"), F.lit(False))
    # The families of whose templates the line is made.
    made = F.filter(_known(), lambda t: F.size(F.array_intersect("terms", t["pairs"])) >= CONFIRM * F.col("n_pairs"))
    made = F.struct(F.col("_paragraph").alias("at"), F.array_distinct(F.transform(made, lambda t: t["family"])).alias("of"))
    seen = (
        looks.groupBy("_row", id_col)
        .agg(
            F.array_distinct(F.flatten(F.collect_set(F.when(F.size("_families") > 0, F.transform("_families", lambda f: F.struct(F.col("_paragraph").alias("at"), f.alias("family"))))))).alias("_confirmed"),
            F.collect_list(F.when(unknown, made)).alias("_unknown"),
            F.coalesce(F.round(F.max(F.when(F.col("_p") >= 0.5, F.col("_p"))), 6), F.lit(0.0)).alias("best_probability"),
            F.coalesce(F.round(F.max(F.col("_s")), 6), F.lit(0.0)).alias("best_similarity"),
        )
    )
    explained = lambda u: F.exists("_confirmed", lambda c: (c["at"] == u["at"]) & F.array_contains(u["of"], c["family"]))
    return seen.select(
        id_col,
        F.array_join(F.array_sort(F.array_distinct(F.transform("_confirmed", lambda c: c["family"]))), ",").alias("licenses"),
        F.size("_confirmed").cast("long").alias("n_confirmed"),
        F.size(F.filter("_unknown", lambda u: ~explained(u))).cast("long").alias("n_unknown"),
        "best_probability",
        "best_similarity",
    )
