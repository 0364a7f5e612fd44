"""Held-out accuracy of the classifier, its parts, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import cotraining as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, quality string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "rivers run long past old mills and the ground is wet in spring but dry later on when winds come from hills".split()


def text_of(rng, good):
    words = [rng.choice(WORDS) for _ in range(rng.randrange(30, 200))]
    if good:
        lines = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, len(words), 12)]
        return "\n".join(lines)
    kind = rng.randrange(3)
    if kind == 0:
        return " | ".join(w.title() for w in words)
    return "!! ".join(words).upper() if kind == 1 else " ".join(f"{w}###" for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(900):
        good = rng.random() < 0.8
        text = text_of(rng, good)
        rows.append((i, text, "en", f"src{rng.randrange(4)}", len(text), "r", "q"))
        truth[i] = int(good)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(0, 900, 3)], LABELS)
    return docs, labels, truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    found = {r.doc_id: r for r in c.scored(docs, c.trained(docs, labels)).select("doc_id", F.col("quality.*")).collect()}
    unseen = [i for i in truth if i % 3]
    assert np.mean([found[i].kept == bool(truth[i]) for i in unseen]) > 0.98
    assert np.mean([found[i].kept for i in unseen if truth[i]]) > 0.99
    for view in ("words", "page"):
        assert np.mean([(found[i][view] > 0.5) == bool(truth[i]) for i in unseen]) > 0.9
    kept = c.kept(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_test_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 4 <> 0")
    truth = labels.where("doc_id % 4 = 0").select("doc_id", F.col("quality").alias("label"))
    rows = c.scored(docs, c.trained(docs, seen)).join(truth, "doc_id").select("quality.kept", "label").collect()
    assert np.mean([r.kept == (r.label == 1) for r in rows]) > 0.93
    assert np.mean([r.kept for r in rows if r.label == 1]) > 0.97


def test_pseudo_labels_come_from_the_other_view():
    """One view sees the class, the other only noise beside few labels: the first teaches the second."""
    rng = np.random.default_rng(5)
    n = 600
    truth = rng.random(n) < 0.6
    label = np.where(np.arange(n) < 60, truth, -1).astype(int)
    words = c.word_rows([c.counted(np.array([10 if t else 11] * 5 + rng.integers(100, 9000, 5).tolist())) for t in truth])
    pages = rng.random((n, c.N_NUMBERS + 2))
    pages[:, 0] += 0.4 * truth
    pages[:, -2:] = 0

    def accuracy(rounds):
        model = c.fit(words, pages, label, rounds)
        return np.mean((model.log_odds(words, c.page_rows(pages, model.edges))[1][60:] > 0) == truth[60:])

    assert accuracy(5) > accuracy(0)


def test_calibrated_odds_match_shares():
    rng = np.random.default_rng(1)
    odds = rng.normal(size=4000) * 2
    good = rng.random(4000) < c.sigmoid(0.5 * odds + 1)
    slope, shift = c.calibration(odds, good)
    assert slope == pytest.approx(0.5, abs=0.1) and shift == pytest.approx(1, abs=0.15)


def test_odd_rows(spark, corpus):
    docs, labels, _ = corpus
    odd = [
        (5000, None, None, None, None, None, None), (5001, "", "en", "src0", 0, "", ""), (None, "no id", "en", "src0", 5, "", ""),
        (5002, "word " * 100_000, "en", "src1", 500_000, "", ""), (5003, "dup", "xx", "new", 3, "", ""), (5003, "dup", "xx", "new", 3, "", ""),
    ]
    both = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 0, 0), (3, 1, 0), (9999, 1, 0)], LABELS))
    rows = c.scored(both, c.trained(both, more)).select("doc_id", F.col("quality.*")).collect()
    assert len(rows) == docs.count() + len(odd)
    assert all(r.kept is not None and 0 <= r.good <= 1 for r in rows)
    same = [r for r in rows if r.doc_id == 5003]
    assert len(same) == 2 and same[0] == same[1]


def test_nothing_to_fit_on(spark, corpus):
    docs, labels, _ = corpus
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert c.trained(docs, none) is None
        assert c.kept(docs, none).count() == docs.count()
    empty = docs.limit(0)
    assert c.kept(empty, labels).count() == 0
