"""Fingerprints and groups against plain Python."""

from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from tallyline.llm import simhash_dedup as sd
from tallyline.llm.common import Scratch

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text: str | None) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(numbers: list[int], radius: int = 3) -> list[int]:
    root = list(range(len(numbers)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(numbers):
        for j in range(i):
            if (a ^ numbers[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(numbers))]


def test_fingerprints(spark):
    texts = [None, "", " \n ", "One", "one two", "One TWO three", "É é x y z", "a b c d " * 30, "x\x1cy z w v"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    marked = rows.select("n", sd.simhash(F.col("text")).alias("f")).select("n", sd.hex_of("f").alias("h"))
    assert {r.n: r.h for r in marked.collect()} == {n: f"{plain_fingerprint(t):016x}" for n, t in enumerate(texts)}


def test_masks_cover_every_difference():
    masks = sd.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in masks)
    masks, rng = sd.covering_masks(3), random.Random(1)
    for _ in range(20_000):
        difference = sum({1 << rng.randrange(64) for _ in range(3)})
        assert any(not m & difference for m in masks)


def crowd(n: int, seed: int) -> list[int]:
    """Fingerprints around a few centres, so that links form chains and dense groups."""
    rng = random.Random(seed)
    found = [rng.getrandbits(64) for _ in range(n // 20)]
    while len(found) < n:
        x = rng.choice(found)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        found.append(x)
    return sorted(set(found))


def groups(spark, numbers, group):
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(sd.signed(x),) for x in numbers], "fp long")
    roots = sd.components(sd.covering_links(df, scratch, group=group), scratch)
    return {r.node % 2**64: r.root % 2**64 for r in roots.collect()}


def same_partition(numbers, roots, plain):
    classes = {}
    for i, x in enumerate(numbers):
        classes.setdefault(plain[i], set()).add(x)
    mine = {}
    for x in numbers:
        mine.setdefault(roots.get(x, x), set()).add(x)
    return sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_groups_equal_brute_force(spark):
    numbers = crowd(600, 3)
    assert same_partition(numbers, groups(spark, numbers, sd.GROUP), plain_components(numbers))


def test_crowded_keys_are_cut_without_losing_a_link(spark):
    rng = random.Random(5)
    numbers = sorted({sum(1 << rng.randrange(64) for _ in range(rng.randrange(0, 5))) % 2**64 for _ in range(400)})
    assert same_partition(numbers, groups(spark, numbers, 8), plain_components(numbers))


def test_rows_and_cases(spark):
    near = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals " * 6
    rows = [(5, near), (3, near + "today"), (9, near), (9, near), (1, None), (2, ""), (4, "unlike any other text here"), (None, near)]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    found = sd.near_duplicates(df).collect()
    prints = [plain_fingerprint(t) for a, t in rows if a is not None]
    ids = [a for a, _ in rows if a is not None]
    plain = plain_components(prints)
    least = {}
    for i, c in zip(ids, plain):
        least[c] = min(i, least.get(c, i))
    expected = sorted((i, p, least[c]) for i, p, c in zip(ids, prints, plain))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in found if r.doc_id is not None) == expected
    assert [(r.fp % 2**64, r.component_id) for r in found if r.doc_id is None] == [(plain_fingerprint(near), None)]
    kept = sorted(r.doc_id for r in sd.keep_one(df).collect() if r.doc_id is not None)
    assert kept == sorted(set(least.values()))
    assert sd.keep_one(df).columns == df.columns


def test_empty_table(spark):
    assert sd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sd.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
