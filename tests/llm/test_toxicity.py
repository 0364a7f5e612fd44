"""Restored texts against an exhaustive search of the lattice, scores by held-out accuracy."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest import DATA

from tallyline.llm import toxicity as tox
from tallyline.llm.queries import QUERIES

DOCS = "score double, doc_id long, text string, lang string, source string, predicted string"
LABELS = "doc_id long, quality int, toxic int, text string"
PLAIN = "the quick brown fox jumps over a lazy dog while good people read books about music and science".split()
BAD = ["grumpface", "slimehead", "stinkfoot"]


def prose(rng, n):
    return " ".join(rng.choice(PLAIN) for _ in range(n)).capitalize() + "."


def corpus(n=900, seed=1):
    """Every fifth document holds bad words."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.choice([5, 30, 120])).split()
        if i % 5 == 0:
            for bad in rng.sample(BAD, 2):
                words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return docs, labels


@pytest.fixture(scope="module")
def model():
    docs, _ = corpus()
    counts = np.bincount(tox.grams("\n".join(t for _, t in docs)), minlength=tox.SYMBOLS**4)
    return tox.costs(counts.astype(float))


def test_grams_are_counts_within_words():
    def symbol(c):
        return ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0

    text = "The end, or né é 12 it's\n中文a"
    expected = Counter()
    for word in "".join(c.lower() if symbol(c.lower()) else " " for c in text).split():
        s = [0, 0, 0, *map(symbol, word), 0]
        for i in range(3, len(s)):
            expected[((s[i - 3] * 28 + s[i - 2]) * 28 + s[i - 1]) * 28 + s[i]] += 1
    assert Counter(tox.grams(text).tolist()) == expected


def test_costs_are_shares(model):
    assert np.allclose(np.exp(-model.astype(float)).sum(axis=3)[model.sum(axis=3) > 0].max(), 1, atol=0.2)
    assert model[0, 0, 0][20] < model[0, 0, 0][26]  # words begin with t, not with z


def every_path(written, model):
    """The cheapest of all paths, one by one."""
    stars = "***" not in written
    written = written.lower()
    choices = [tox.edges(c, written[i - 1] if i else "", stars) for i, c in enumerate(written)]
    best = None
    for path in itertools.product(*choices):
        cost, state = sum(c for _, c in path), (0, 0, 0)
        for meant, _ in path:
            if meant == " ":
                cost += float(model[state][0]) if state != (0, 0, 0) else 0.0
                state = (0, 0, 0)
            elif meant:
                s = tox.symbol(meant)
                cost += float(model[state][s])
                state = (state[1], state[2], s)
        cost += float(model[state][0]) if state != (0, 0, 0) else 0.0
        text = " ".join("".join(m for m, _ in path).split())
        if best is None or cost < best[0] - 1e-6:
            best = (cost, text)
    return best


def test_viterbi_is_the_best_path(model):
    rng = random.Random(2)
    for _ in range(150):
        written = "".join(rng.choice("qu1ck0o3e l*!5st-") for _ in range(rng.randrange(1, 7)))
        cost, text = every_path(written, model)
        got = tox.decoded(written, model)
        if got != text:  # equally good
            readings = {every_path(written, model)[1], got}
            assert len(readings) == 2 and abs(cost - path_cost(written, got, model)) < 1e-4


def path_cost(written, text, model):
    stars = "***" not in written
    written = written.lower()
    choices = [tox.edges(c, written[i - 1] if i else "", stars) for i, c in enumerate(written)]
    costs = []
    for path in itertools.product(*choices):
        if " ".join("".join(m for m, _ in path).split()) != text:
            continue
        cost, state = sum(c for _, c in path), (0, 0, 0)
        for meant, _ in path:
            if meant == " ":
                cost += float(model[state][0]) if state != (0, 0, 0) else 0.0
                state = (0, 0, 0)
            elif meant:
                s = tox.symbol(meant)
                cost += float(model[state][s])
                state = (state[1], state[2], s)
        costs.append(cost + (float(model[state][0]) if state != (0, 0, 0) else 0.0))
    return min(costs)


@pytest.mark.parametrize(
    "written",
    ["Sl1m3h3ad", "s l i m e h e a d", "s.l.i.m.e.h.e.a.d", "sliiimeheaddd", "SLIMEHEAD!!", "sl*mehead", "s-l-i-m-e-head", "ssl1imehead"],
)
def test_restores(written, model):
    assert "slimehead" in tox.restored(f"the dog {written} read books", model).lower()


def test_plain_texts_stay(model):
    text = "The quick brown fox jumps over a lazy dog"
    assert tox.restored(text, model) == text
    assert tox.restored(None, model) == tox.restored(" ", model) == ""


def test_skeleton_is_the_same_for_all_readings(model):
    rng = random.Random(4)
    for _ in range(300):
        written = "".join(rng.choice("abeilost0135!$|+-.") for _ in range(rng.randrange(1, 9)))
        for word in [tox.decoded(written, model)]:
            assert tox.skeleton(word.replace(" ", "")) == tox.skeleton(written) or " " in word or tox.skeleton(word) in subsequences(tox.skeleton(written))


def subsequences(text):
    """Signs may stand for nothing: what is left is a part of the skeleton."""
    found = {""}
    for c in text:
        found |= {x + c if not x.endswith(c) else x for x in found}
    return found


def frames(spark, docs, labels):
    table = spark.createDataFrame([(0.5, i, t, "en", "s", "x") for i, t in docs], DOCS).repartition(4)
    return table, spark.createDataFrame([(i, 1, t, "x") for i, t in labels], LABELS)


DISGUISES = [
    lambda w: w.replace("e", "3").replace("i", "1"),
    lambda w: " ".join(w),
    lambda w: w.replace("o", "0").replace("s", "$").replace("a", "@"),
    lambda w: ".".join(w),
    lambda w: w[:3] + w[2] * 3 + w[3:],
    lambda w: "".join(2 * c for c in w),
    lambda w: w.upper() + "!!",
    lambda w: w[:2] + "*" + w[3:],
]


def test_finds_disguised_words_and_leaves_clean_texts(spark):
    docs, labels = corpus()
    rng = random.Random(3)
    hidden = [(10_000 + i, prose(rng, 40) + f" {disguise(rng.choice(BAD))} " + prose(rng, 20)) for i, disguise in enumerate(DISGUISES * 5)]
    clean = [(20_000 + i, prose(rng, 60) + rng.choice([" B00k 42 ", " a b c d ", " 2024-01-01 ", " goood!! ", " $100 ", " x*y "])) for i in range(60)]
    odd = [(30_000, None), (30_001, ""), (None, docs[0][1]), (30_002, docs[0][1]), (30_003, prose(rng, 60_000)), (30_004, "x" * 50_000)]
    table, known = frames(spark, docs + hidden + clean + odd, labels + [(30_002, 0), (30_002, 1), (None, 1), (5, None)])
    rows = tox.toxicity(table, known).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs + hidden + clean + odd)
    assert rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    missed = [t for i, t in hidden if not got[i].predicted]
    assert len(missed) <= 2, missed
    assert not [t for i, t in clean if got[i].predicted]
    assert all(got[i].predicted == label for i, label in labels)
    assert got[30_000].score == got[30_001].score < 0.3 and got[30_003].predicted == got[30_004].predicted == 0
    assert got[None].score == got[30_002].score == got[0].score and not got[None].held_out
    assert all(got[i].held_out == (crc32(str(i).encode()) % 4 == 2) for i, _ in docs)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_scores_come_from_texts_alone(spark):
    docs, labels = corpus(300)
    table, known = frames(spark, docs, labels)
    model = tox.trained(table, known)
    plain = {r.doc_id: r.score for r in tox.scored(table, model).collect()}
    other = table.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang", "cast(null as string) as source")
    assert plain == {r.doc_id - 7: r.score for r in tox.scored(other, model).collect()}


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(300)
    table, known = frames(spark, docs, labels)
    turned = [(i, 1 - t if crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    _, other = frames(spark, docs, turned)
    assert sorted(tox.toxicity(table, known).collect()) == sorted(tox.toxicity(table, other).collect())


def test_without_labels_or_documents(spark):
    docs, labels = corpus(40)
    table, known = frames(spark, docs, [])
    assert {r.score for r in tox.toxicity(table, known).collect()} == {0.0}
    table, known = frames(spark, docs, [(i, 0) for i, _ in labels])
    assert {r.score for r in tox.toxicity(table, known).collect()} == {0.0}
    table, known = frames(spark, [], labels)
    assert tox.toxicity(table, known).collect() == []


def test_copies_prove_no_more_than_one(spark):
    """Words of a toxic text copied a thousand times don't make clean texts toxic."""
    docs, labels = corpus(400)
    copied = " ".join(f"{w}er" for w in PLAIN) + " grumpface"
    docs += [(5000 + i, copied) for i in range(1000)] + [(9000, prose(random.Random(9), 30) + " foxer doger lazyer")]
    table, known = frames(spark, docs, labels + [(5000 + i, 1) for i in range(1000)])
    got = {r.doc_id: r.predicted for r in tox.toxicity(table, known).collect()}
    assert got[5000] == 1 and got[9000] == 0


def test_held_out_accuracy(spark):
    folder = DATA.replace("0.001", "0.01")
    rows = QUERIES["op13_toxicity"](spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    langs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").where("lang = 'en'")
    seen = Counter(tuple(r) for r in rows.join(labels, "doc_id").join(langs, "doc_id").select("toxic", "predicted").collect())
    assert seen[1, 1] >= 0.75 * (seen[1, 0] + seen[1, 1])
    assert seen[0, 1] <= 0.1 * (seen[0, 0] + seen[0, 1])
