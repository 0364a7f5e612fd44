"""Removed spans against counting every string of the length, over all sizes of buckets and crowds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, chunk int, kept string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8)])))
        kept = bytes(b for b, c in zip(d, covered) if not c)
        out.append((len(d), edges[::2].tolist(), edges[1::2].tolist(), kept))
    return out


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], SCHEMA)
    got = s.without_repeats(df, **sizes).collect()
    return sorted(((r.doc_id, r.n_bytes, r.starts, r.ends, bytes(r.kept)) for r in got), key=repr)


def expected(rows, length):
    return sorted(((a, *x) for (a, _), x in zip(rows, brute([b for _, b in rows], length))), key=repr)


def corpus(seed, n=60):
    """Random texts with shared passages, near copies, periods and accents."""
    rng = random.Random(seed)
    letters = "abcdé "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randrange(5, 60))))
            elif kind < 0.8:
                whole = rng.choice(passages)
                a, b = sorted(rng.randrange(len(whole) + 1) for _ in range(2))
                parts.append(rng.choice([whole, whole[a:b], whole[a:]]))
            else:
                parts.append(rng.choice(["x", "ab", passages[0][:7]]) * rng.randrange(1, 30))
        texts.append("".join(parts))
    for t in texts[:10]:
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + "Z" + t[at:])
    return list(enumerate(texts + texts[:3]))


@pytest.mark.parametrize(
    ("seed", "length", "gram", "chunk", "crowd", "most"),
    [(1, 30, 8, 500, 99, 999), (2, 30, 8, 500, 2, 999), (3, 20, 20, 2000, 99, 3), (4, 33, 1, 300, 5, 9), (5, 24, 12, 10**6, 4, 9)],
)
def test_equals_brute_force(spark, seed, length, gram, chunk, crowd, most):
    rows = corpus(seed)
    assert found(spark, rows, length=length, gram=gram, chunk=chunk, crowd=crowd, most=most) == expected(rows, length)


def test_production_length(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(40)) + passage + " ".join(word() for _ in range(30))) for i in range(50)]
    rows += [(100, passage[:199]), (101, passage[:200]), (102, "y" * 5000), (103, "ü" * 150), (104, passage + passage)]
    got = found(spark, rows, chunk=4000, crowd=3)
    assert got == expected(rows, 200)
    assert got == found(spark, rows)


def test_cases(spark):
    long_text = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "short"), (3, "short"), (4, long_text), (None, long_text[1000:1300]), (None, None),
        (5, "twice the same row " * 20), (5, "twice the same row " * 20), (6, "lone " + "abc " * 30),
    ]
    got = found(spark, rows)
    want = expected([r for r in rows if r[0] != 4], 200)
    # the long text shares 300 bytes with the row without id
    small = [r for r in rows if r[0] != 4] + [(4, long_text[500:2000])]
    assert len(got) == len(want) + 1
    of_small = expected(small, 200)
    for r in of_small:
        if r[0] != 4:
            assert r in got
    whole = next(r for r in got if r[0] == 4)
    assert (whole[2], whole[3]) == ([1000], [1300])


def test_blocks_of_a_large_chunk(monkeypatch):
    sizes = s.Repeats(40, 16)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 5000, 39, 40, 41, 700)]
    whole = s.Chunk(texts, sizes).anchors()
    assert set(whole.text.tolist()) == {1, 3, 4, 5}
    monkeypatch.setattr(s, "BLOCK", 333)
    monkeypatch.setattr(s, "_POWERS", [])
    for a, b in zip(whole, s.Chunk(texts, sizes).anchors()):
        assert np.array_equal(a, b)


def test_interval_tree_puts_out_all_occurrences():
    sizes = s.Repeats(10, 4)
    contexts = [b"..abcdWXYZ12", b"..abcdWXYZ12", b"..abcdWXYZ99", b"!!abcdWXYZ12"]
    found = s.Occurrences.of(np.zeros(4, np.uint64), np.full(4, 2), contexts, sizes)
    groups = {(right, tuple(sorted(members.tolist()))) for right, members, _ in s.maximal_repeats(found, sizes)}
    assert groups == {(10, (0, 1, 3)), (8, (0, 1, 2))}


def test_empty_table(spark):
    assert found(spark, []) == []
