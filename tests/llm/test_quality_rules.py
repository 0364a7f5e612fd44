"""Counts and verdicts of the quality rules against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from compare import difference, oracle_connection
from conftest import DATA

from tallyline.llm import quality_rules as q
from tallyline.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, found string, classes int"


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in often for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def distance(a, b):
    a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(sum(part(x, y) + part(y, x) for x, y in zip(a, b)) / 2)


def text_of(rng, n, common=0.6):
    return " ".join(rng.choice(q.COMMON_WORDS["en"].split() if rng.random() < common else ["tree", "Stone", "water,"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    plain = [(i, text_of(rng, 200), "en") for i in range(20)]
    odd = [
        (100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, "a b c a b c a b c", "en"),
        (104, "one\none\n\none\ntwo\x0b\n", "en"), (105, "ÄÖ ü! <b>#1</b> | x\x85y", "de"), (106, "UPPER WORDS " * 80, "en"),
        (107, text_of(rng, 30_000), "en"), (108, " ".join(f"xy{i}" for i in range(300)), "en"),
        (109, text_of(rng, 120), None), (110, text_of(rng, 120), "xx"), (None, text_of(rng, 120), "en"), (0, plain[0][1], "en"),
    ]
    return plain + odd


def test_counts_and_verdicts(spark, rows):
    df = spark.createDataFrame([(a, b, c, "found", 7) for a, b, c in rows], SCHEMA)
    found = q.judged(df).collect()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *(r[c] for c in counts)) for r in found) == Counter((a, *plain_counts(b)) for a, b, _ in rows)
    good = [r for r in found if not r.base_failed]
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        same = [g for g in good if g.lang == r.lang]
        if r.class_distance is not None:
            reference = [sum(g.classes[i] for g in same) for i in range(len(q.CLASSES) + 1)]
            assert r.class_distance == pytest.approx(distance(r.classes, reference), abs=1e-9)
        if r.word_distance is not None:
            reference = [sum(g.word_counts[i] for g in same) for i in range(21)]
            assert r.word_distance == pytest.approx(distance(r.word_counts, reference), abs=1e-7)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[i] for i in range(20)) and kept[110] and kept[109]
    assert not any(kept[i] for i in (100, 101, 102, 103, 106, 108))


def test_classes_partition_the_text(spark):
    text = "".join(map(chr, [*range(0x20, 0x180), 9, 10, 11, 12, 13, 1, 0x1F, 0x2028, 0x1F600])) * 3
    df = spark.createDataFrame([(1, text, "en", "", 0)], SCHEMA)
    got = q.counts(df).first().classes
    ascii_ = lambda low, high: sum(low <= c <= high for c in text)
    expected = {
        "lower": ascii_("a", "z"), "upper": ascii_("A", "Z"), "digit": ascii_("0", "9"),
        "space": sum(c in " \t\n\x0b\x0c\r" for c in text), "punctuation": sum(c in ".,;:!?'\"()-" for c in text),
        "other": sum(ord(c) >= 128 for c in text),
    }
    assert got[:-1] == [expected[k] for k in q.CLASSES]
    assert sum(got) == len(text)


def test_empty_table(spark):
    assert q.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    df = QUERIES["op1_quality_rules"](spark, DATA)
    assert difference(df, oracle_connection(DATA), ORACLES["op1_quality_rules"]) is None


def test_no_python_in_the_plan(spark):
    plan = q.judged(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
