"""Licence scan: planted notices, unseen wordings, and the scores against plain Python."""

from __future__ import annotations

import math
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyline.llm import licences as c

SCHEMA = "doc_id long, text string, line int, family string, found string"
ORDINARY = [
    "The river runs past the old mill and the ground is wet in spring.", "Nothing in this text is about rights or terms.",
    "Er kommt mit dem Zug und liest das Buch, das ihm ein Freund gab.", "She sold copies of the book at the market last year.",
    "Le vent du nord souffle sur la ville et les rues sont vides.", "Call 555 1234 or write to 12 Main Street, version 2.",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, "f", "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(n, "\n".join(ORDINARY[(n + k) % 6] for k in range(4))) for n in range(60)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return c.train(spark, docs(spark, corpus))


def scan(spark, model, texts):
    return {(r.doc_id, r.line): r for r in c.scan(docs(spark, texts), model).collect()}


def test_notices_are_found_and_ordinary_text_is_left_alone(spark, model, corpus):
    planted = {f: texts[0] for f, texts in c.TEMPLATES.items()}
    rows = corpus + [(1000 + n, f"{ORDINARY[0]}\n\n{t}\n{ORDINARY[1]}") for n, t in enumerate(planted.values())]
    found = scan(spark, model, rows)
    assert {k: r.family for k, r in found.items()} == {(1000 + n, 2): f for n, f in enumerate(planted)}
    assert all(r.confirmed and r.chance > 0.5 for r in found.values())


def test_other_wordings(spark, model):
    texts = [
        (1, "This module is released under the MIT License, see LICENSE."),
        (2, "   * Licensed under the Apache License, Version 2.0 (the License); you may not use this file except"),
        (3, "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
        (4, "You may redistribute apples in source and binary."),
    ]
    found = scan(spark, model, texts)
    families = {k[0]: r.family for k, r in found.items() if r.confirmed}
    assert families == {1: "mit", 2: "apache-2.0", 3: "gpl"}


def test_scores_are_the_models(spark, model):
    """The chances of all paragraphs, computed from the weights by hand, without keywords."""
    texts = [(n, t) for n, t in enumerate([*ORDINARY, *(t for v in c.TEMPLATES.values() for t in v), "the license", "mit"])]
    expected = {}
    for n, text in texts:
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        own = {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
        logits = list(model.intercepts)
        for gram, weights in zip(model.grams, model.weights):
            if gram in own:
                logits = [a + b for a, b in zip(logits, weights)]
        top = max(logits)
        chance = 1 / sum(math.exp((z - top) / model.temperature) for z in logits)
        family = model.families[logits.index(top)]
        if family != c.UNKNOWN and chance >= 0.5:
            expected[n, 0] = (family, round(chance, 9))
    found = scan(spark, model, texts)
    assert {k: (r.family, round(r.chance, 9)) for k, r in found.items()} == expected
    assert len(expected) > 25


def test_paragraphs_without_a_feature_are_unknown(model):
    assert model.families[model.intercepts.index(max(model.intercepts))] == c.UNKNOWN


def test_odd_rows(spark, model):
    notice = "Released under the MIT License."
    texts = [(1, None), (2, ""), (3, "\n\n"), (4, f"{notice}\n{notice}"), (5, notice), (5, notice), (None, notice), (6, "x " * 100_000 + "\n" + notice)]
    rows = c.scan(docs(spark, texts), model).collect()
    assert sorted((r.doc_id or -1, r.line) for r in rows) == [(-1, 0), (4, 0), (4, 1), (5, 0), (5, 0), (6, 1)]
    assert {r.family for r in rows} == {"mit"}


def test_empty_table(spark):
    assert c.scan(docs(spark, [])).count() == 0


def test_test_table(spark, model):
    """Every line of the table that is one of the notices is found, and no other line."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    found = c.scan(table)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    lines = {(r.doc_id, i): t for r in table.collect() for i, t in enumerate((r.text or "").split("\n"))}
    notices = {t: f for f, v in c.TEMPLATES.items() for t in v}
    expected = {k: notices[t] for k, t in lines.items() if t in notices}
    confirmed = found.where("confirmed").select("doc_id", "line", F.col("family")).collect()
    assert expected.items() <= {(r.doc_id, r.line): r.family for r in confirmed}.items()
    assert all(re.search("licen|copyright|rights", lines[r.doc_id, r.line], re.I) for r in confirmed)


def test_every_family_of_a_line_is_found(spark, model):
    long = " ".join(
        [*ORDINARY * 5, c.TEMPLATES["mit"][2], *ORDINARY * 5, c.TEMPLATES["apache-2.0"][2], *ORDINARY, c.TEMPLATES["mpl-2.0"][0], *ORDINARY]
    )
    lgpl = (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    )
    texts = [
        (1, "Released under the MIT License or the Apache License, Version 2.0."),
        (2, "Licensed under the Apache License, Version 2.0 or the MIT license, at your option."),
        (3, "Licensed under the MIT license. See the LICENSE file for details. Licensed under the Apache License, Version 2.0."),
        (4, long), (5, lgpl), (6, "Released under the MIT License."),
        (7, "Released under the BSD 3-Clause License, or released under the GPL v2 or later."),
    ]
    found = {}
    for r in c.scan(docs(spark, texts), model).where("confirmed").collect():
        found.setdefault(r.doc_id, []).append(r.family)
    assert {k: sorted(v) for k, v in found.items()} == {
        1: ["apache-2.0", "mit"], 2: ["apache-2.0", "mit"], 3: ["apache-2.0", "mit"], 4: ["apache-2.0", "mit", "mpl-2.0"],
        5: ["lgpl"], 6: ["mit"], 7: ["bsd", "gpl"],
    }
