"""Weights and permutations of the mixture against a plain computation."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyline.llm import mixing as m
from tallyline.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, key string, epoch int, tokens int"


def table(spark, rows):
    return spark.createDataFrame([(a, b, c, "k", 1, 2) for a, b, c in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    sizes = {"hot": 300, "a": 40, "b": 25, "c": 10, None: 5}
    found, n = [], 0
    for source, count in sizes.items():
        for i in range(count):
            found.append((n, "w " * (1 + (i * 7) % 23), source))
            n += 1
    return found + [(n, None, "a"), (n + 1, "", "b"), (None, "x y", "a"), (5, "w " * 30, "hot"), (5, "w " * 30, "hot"), (n + 2, "", "void")]


def totals(rows):
    sums = Counter()
    for _, text, source in rows:
        sums[source] += len((text or "").split())
    return sums


def weights_at(sums, a):
    z = sum((t / sum(sums.values())) ** a for t in sums.values() if t)
    return {s: (t / sum(sums.values())) ** a / z for s, t in sums.items() if t}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


@pytest.mark.parametrize(("repeats", "target", "budget"), [(2.0, 1.0, None), (50.0, 0.9, None), (3.0, 0.8, 4000), (1e9, 1.0, 500)])
def test_exponent_is_the_smallest_within_limits(spark, rows, repeats, target, budget):
    scratch = Scratch(spark, "test")
    mixture = m.planned(m.measured(table(spark, rows)), scratch, repeats, target, budget)
    sums = totals(rows)

    def within(a):
        w = weights_at(sums, a)
        of = {s: x / sums[s] for s, x in w.items()}
        most = max(of.values()) / min(of.values()) if budget is None else max(of.values()) * budget
        return most <= repeats * (1 + 1e-6) and entropy(w) <= target * math.log(len(w)) + 1e-6

    assert within(mixture.exponent) or mixture.exponent == 1
    assert mixture.exponent < 1e-6 or not within(mixture.exponent - 1e-4)
    w = weights_at(sums, mixture.exponent)
    for r in mixture.sources.collect():
        name = None if r.key == "n" else r.key[1:]
        assert r.weight == pytest.approx(w.get(name, 0), abs=1e-6)


@pytest.mark.parametrize("limits", [{"max_repeats": 2.5, "target_entropy": 1.0}, {"max_repeats": 9.0, "target_entropy": 0.9, "budget": 700, "block_tokens": 64}])
def test_epochs_are_whole_permutations_and_a_prefix(spark, rows, limits):
    df = table(spark, rows)
    scratch = Scratch(spark, "test")
    measured = scratch.keep(m.measured(df), "tokens")
    mixture = m.planned(measured, scratch, **limits)
    plan = {r.key: r for r in mixture.sources.collect()}
    used = m.placements(measured, mixture).collect()
    per = defaultdict(list)
    for r in used:
        per[r.key, r.epoch].append(r)
    ids = defaultdict(Counter)
    for doc_id, text, source in rows:
        ids["n" if source is None else "s" + source][doc_id, len((text or "").split())] += 1
    for key, p in plan.items():
        for epoch in range(p.full):
            assert Counter((r.doc_id, r.n_tokens) for r in per[key, epoch]) == ids[key]
        ordered = m.measured(df).where(F.col("key") == key).withColumn("epoch", F.lit(p.full).cast("long")).withColumn("buckets", F.lit(p.buckets))
        ordered = ordered.select("doc_id", "n_tokens", *m.order_keys(m.SEED)).collect()
        ordered.sort(key=lambda r: (r.bucket, r.place, r.doc_id or -1, r.n_tokens))
        prefix, total = [], 0
        for r in ordered:
            total += r.n_tokens
            if p.rest == 0 or total > p.rest:
                break
            prefix.append((r.doc_id, r.n_tokens))
        assert Counter((r.doc_id, r.n_tokens) for r in per[key, p.full]) == Counter(prefix)
        assert p.full * p.tokens + p.rest == p.quota or p.tokens == 0
    blocks = defaultdict(list)
    for r in used:
        blocks[r.block].append(r.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in blocks.values())
    assert set(blocks) <= set(range(mixture.n_blocks))


def test_mixed_repeats_rows(spark, rows):
    df = table(spark, rows)
    limits = {"max_repeats": 2.5, "target_entropy": 1.0}
    out = m.mixed(df, **limits)
    assert out.columns == df.columns
    expected = Counter((r.doc_id, r.n_tokens, r.source) for r in m.mix(df, **limits).collect())
    assert Counter((r.doc_id, len((r.text or "").split()), r.source) for r in out.collect()) == expected
    kept = Counter((r.doc_id, r.source) for r in out.collect())
    assert set(kept) >= {(a, c) for a, _, c in rows}


def test_empty_tables(spark):
    assert m.mix(table(spark, [])).count() == 0
    assert m.mixed(table(spark, [])).count() == 0
    nothing = table(spark, [(1, None, "a"), (2, "", None)])
    assert m.mix(nothing).count() == 2 and m.mixed(nothing).count() == 2


def test_no_python_in_the_plan(spark, rows):
    for df in (m.mix(table(spark, rows)), m.mixed(table(spark, rows))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_texts_stay_where_they_are(spark, rows):
    """The plan of `mixed` has no exchange of the texts, and the table of sources is looked up."""
    plan = m.mixed(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(key" in line and "row" in line]


def test_many_sources_give_the_same(spark, rows, monkeypatch):
    df = table(spark, rows)
    limits = {"max_repeats": 2.5, "target_entropy": 1.0}
    few = Counter(map(tuple, m.mix(df, **limits).collect())), Counter(map(tuple, m.mixed(df, **limits).collect()))
    monkeypatch.setattr(m, "MOST_SOURCES", 2)
    assert few == (Counter(map(tuple, m.mix(df, **limits).collect())), Counter(map(tuple, m.mixed(df, **limits).collect())))


def test_runs_of_buckets_add_up(spark, rows, monkeypatch):
    df = table(spark, rows)
    limits = {"max_repeats": 2.5, "target_entropy": 1.0}
    monkeypatch.setattr(m, "BUCKET", 4)
    whole = Counter(map(tuple, m.mix(df, **limits).collect()))
    monkeypatch.setattr(m, "RUN", 3)
    assert whole == Counter(map(tuple, m.mix(df, **limits).collect()))


def test_rows_without_tokens_spread_over_the_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 50)
    empty = [(10_000 + i, "", "void") for i in range(2000)]
    for df in (table(spark, rows + empty), table(spark, empty)):
        sizes = Counter(r.block for r in m.mix(df).where("source = 'void'").collect())
        assert sum(sizes.values()) >= 2000 and len(sizes) > 20 and max(sizes.values()) < 200
