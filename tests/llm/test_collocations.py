"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import difference, oracle_connection
from conftest import DATA

from tallyline.llm import collocations as col
from tallyline.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "phrase string, lang string, text string, a long, n string"


def brute(rows, limit=2000, least=10, covered=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= covered * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return Counter(out)


def found(spark, rows, **more):
    table = spark.createDataFrame([("x", lang, text, 1, "y") for lang, text in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, col.collocations(table, **more).collect()))


def corpus(seed, n, lang="en"):
    """Texts of common words with phrases that keep together, some always, some often, some in longer ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "A\x1fb", "0"]
    fixed = ["new york city", "new york", "red hot", "red hot chili", "a b c d", "x x x x", "the the", "of the"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.choice([3, 30]))]
        out.append((lang, "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts)))
    return out


@pytest.mark.parametrize("limit", [2000, 20, 3, 1])
def test_equals_brute_force(spark, limit, monkeypatch):
    rows = corpus(1, 300) + corpus(2, 60, "de") + corpus(3, 30, None) + corpus(4, 10, "und")
    rows += [("en", None), (None, ""), ("fr", " .. "), ("en", "NEW York CITY " * 3000), ("es", "once only")]
    monkeypatch.setattr(col, "FIRST", 1)
    assert found(spark, rows, limit=limit) == brute(rows, limit)


def test_rounds_go_on_until_settled(spark, monkeypatch):
    """All the best pairs are put out by triples: the first limits settle nothing."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        rows += [("en", f"a{i} b{i} c{i}. z{rng.randrange(9)} y{rng.randrange(9)}")] * 12
    rows += corpus(9, 100)
    passes = []
    plain = col.counts
    monkeypatch.setattr(col, "counts", lambda docs, size, marks=None: passes.append(size) or plain(docs, size, marks))
    monkeypatch.setattr(col, "FIRST", 1)
    monkeypatch.setattr(col, "MORE", 2)
    assert found(spark, rows, limit=70) == brute(rows, 70)
    assert passes.count(3) > 1


def test_small_buffers_and_crowded_marks(spark, monkeypatch):
    rows = corpus(5, 200) + corpus(6, 200, "de")
    monkeypatch.setattr(col, "KEPT", 50)
    monkeypatch.setattr(col.marked, "__defaults__", (8,))  # every phrase shares its mark with others
    assert found(spark, rows, limit=30) == brute(rows, 30)


def test_bounds_open_fewer_triples(spark, monkeypatch):
    rows = corpus(7, 400)
    asked = []
    plain = col.triples_of
    monkeypatch.setattr(col, "triples_of", lambda pairs, c, least: asked.append(c.count()) or plain(pairs, c, least))
    found(spark, rows, limit=2)
    found(spark, rows, limit=2000)
    assert asked[0] < asked[-1]


def test_many_languages(spark, monkeypatch):
    rows = [(f"l{i}", "one two. " * 10) for i in range(40)]
    monkeypatch.setattr(col, "MOST_LANGS", 5)
    assert found(spark, rows) == brute(rows)


def test_large_counts_are_exact(spark):
    big = 3 * 10**14
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long").select(col.score("a", "l", "r")).first()
    assert row[0] == 10**6 * big * big // ((big + 1) * (big + 7))


def test_empty(spark):
    assert not found(spark, [])
    assert not found(spark, [("en", None), (None, "a b")])


def test_marks_hold_what_is_marked(spark):
    rows = [("en", f"p q{i}", 1 + i % 15) for i in range(200)]
    marks = col.marked(spark.createDataFrame(rows, "lang string, phrase string, flags int"))
    held = marks.of(b"en", [p.encode() for _, p, _ in rows])
    assert np.all(held & np.array([f for *_, f in rows]) == [f for *_, f in rows])


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_query_equals_sql(spark, folder):
    name = "op12_collocations"
    assert difference(QUERIES[name](spark, folder), oracle_connection(folder), ORACLES[name]) is None
