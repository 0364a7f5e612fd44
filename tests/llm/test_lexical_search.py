"""Ranked lexical search against a plain computation of every score."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import difference, oracle_connection
from conftest import DATA

from tallyline.llm import lexical_search as search
from tallyline.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS, ITEMS = "text string, doc_id long, score int, terms string", "item_id int, doc_id string, text string"


def words_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    """All scores, sorted."""
    found = [(doc, Counter(words_of(t)), len(words_of(t))) for doc, t in docs]
    found = [x for x in found if x[2]]
    n_docs, n_terms = len(found), sum(x[2] for x in found)
    rows = []
    for item, text in set(items):
        scores = []
        for doc, counts, n in found:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for term, times in Counter(words_of(text)).items():
                df = sum(term in c for _, c, _ in found)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                tf = counts[term]
                score += times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)) if tf else 0
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:top], 1)]
    return Counter(rows)


def found(spark, docs, items, top=20):
    table = spark.createDataFrame([(t, d, 7, "x") for d, t in docs], DOCS).repartition(3)
    rows = search.search(table, spark.createDataFrame([(i, "no id", t) for i, t in items], ITEMS), top)
    return Counter(map(tuple, rows.select("item_id", "rank", "doc_id", "score").collect()))


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Élan", "élan", "naïve", "x" * 40, "7", "中文"]
    docs = [(i, prose(rng, rng.choice([1, 3, 20, 200]), words)) for i in range(300)]
    docs += [(1000 + i % 7, docs[3][1]) for i in range(40)]  # repeated texts and ids: ties
    docs += [(2000, None), (2001, ""), (2002, " .,;-"), (None, docs[5][1]), (None, "w1"), (2003, "W1 w1\x00w2\x7fw3")]
    docs += [(2004, prose(rng, 30000, words))]
    items = [(i, prose(rng, rng.choice([1, 5, 40]), words)) for i in range(20)]
    items += [(3, "w1 w2"), (3, "w1 w2"), (None, "w3"), (50, None), (51, ""), (52, "unknown words"), (53, "w1 " * 500)]
    monkeypatch.setattr(search, "ROWS", 37)
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 2) == brute(docs, items, 2)


def test_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, prose(rng, 20, words)) for i in range(60)]
    items = [(i, prose(rng, 6, words)) for i in range(12)]
    monkeypatch.setattr(search, "QUERIES", 5)
    monkeypatch.setattr(search, "GROUP", 2)
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert not found(spark, [], [(1, "a")])
    assert not found(spark, [(1, "a")], [])
    assert not found(spark, [(1, None)], [(1, "a")])


def test_bounds_hold_and_prune():
    """No document scores more than its node allows, and a far cluster is never scored."""
    rng = np.random.default_rng(3)
    n, size = 400, 40
    half = size // 2
    rows = [np.sort(rng.choice(half, 8, replace=False)) + (half if i % 2 else 0) for i in range(n)]
    starts = np.arange(0, 8 * n + 1, 8)
    values = rng.integers(1, 10**6, 8 * n)
    data = search.Rows(np.arange(n), starts, np.concatenate(rows), values)
    band = np.arange(size) * search.BANDS // size
    tree = search.ball_tree(data, band)
    weight = rng.integers(0, 9000, size)
    best = [search.Best(search.Query(k, np.arange(k, k + 6), np.ones(6, np.int64)), weight, 5) for k in (0, 3, 22)]
    group = search.Group(best, band)

    def documents(node):
        if isinstance(node, search.Leaf):
            return list(node.ids)
        return [i for child in node.children for i in documents(child)]

    def check(node):
        if isinstance(node, search.Node):
            limits = group.bounds(node)
            for child, limit in zip(node.children, limits):
                for k, query in enumerate(best):
                    for i in documents(child):
                        part = slice(starts[i], starts[i + 1])
                        inside = dict(zip(query.terms.tolist(), query.values.tolist()))
                        score = sum(inside.get(int(t), 0) * int(v) for t, v in zip(data.terms[part], values[part]))
                        assert score <= limit[k]
                check(child)

    check(tree.child)
    group.search(tree)
    assert all(q.scored <= n // 2 + search.LEAF for q in best)


def test_blocks_hold_all_rows_once():
    rows = [(i if i % 5 else None, i % 7 + 3, list(range(i % 7)), [1] * (i % 7)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            pa.array([r[3] for r in rows], pa.list_(pa.int32())),
        ],
        ["doc_id", "n", "terms", "counts"],
    )
    made = list(search.blocks(iter([batch, batch]), rows=16, entries=20))
    assert all(len(b[0]) <= 16 and (b[2][-1] <= 20 or len(b[0]) == 1) for b in made)
    sizes = [int(s) for b in made for s in np.diff(b[2])]
    assert sizes == [len(r[2]) for r in rows] * 2
    assert [i for b in made for i in b[0].tolist()] == [r[0] if r[0] is not None else search.NO_ID for r in rows] * 2


def test_spares_documents(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    assert search.share_scored(docs, items) < 0.9


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_query_equals_sql(spark, folder):
    name = "op11_lexical_search"
    assert difference(QUERIES[name](spark, folder), oracle_connection(folder), ORACLES[name]) is None
