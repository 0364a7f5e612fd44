"""The tree hash against the same levels in plain Python, with rows that meet in no one task."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallyline.functions import hashing


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves: list[str], width: int, levels: int) -> str:
    for _ in range(levels):
        leaves = [sha("".join(leaves[i : i + width])) for i in range(0, len(leaves), width)]
    return leaves[0]


def test_tree_hash_over_levels(spark, monkeypatch):
    monkeypatch.setattr(hashing, "TREE_WIDTH", 3)
    sizes = {"a": 1, "b": 3, "c": 4, "d": 80}
    rows = [(k, i, f"{k}{i % 7}") for k, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "k string, nth long, text string")
    for parts in (1, 7):
        found = hashing.tree_hashes(table.repartition(parts), ["k"], "nth", hashing.sha256_hex(F.col("text")))
        assert {r.k: r.tree_hash for r in found.collect()} == {
            k: plain([sha(f"{k}{i % 7}") for i in range(n)], 3, 4) for k, n in sizes.items()
        }


def test_order_counts_and_no_rows_give_none(spark):
    table = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 1, "x")], "k string, nth long, t string")
    leaf = hashing.sha256_hex(F.col("t"))
    one, other = (r.tree_hash for r in hashing.tree_hashes(table, ["k"], "nth", leaf).collect())
    assert one != other
    assert hashing.tree_hashes(table.limit(0), ["k"], "nth", leaf).count() == 0
