"""Percentiles against the built-in function and a plain sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyline.functions import percentiles
from tallyline.functions.percentiles import nearest_rank

NAMES = {"p1": 1, "p50": 50, "p95": 95, "p100": 100}


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_equals_a_plain_sort(spark, monkeypatch, bits):
    monkeypatch.setattr(percentiles, "BUCKET_BITS", bits)
    rng = random.Random(bits)
    rows = []
    for group in ("one", "few", "many", "ties", "wide", None):
        n = {"one": 1, "few": 7, "many": 3000}.get(group, 400)
        top = {"ties": 3, "wide": 1 << 62}.get(group, 900)
        rows += [(group, rng.choice([rng.randrange(top), -rng.randrange(top), None])) for _ in range(n)]
    rows += [("none", None)] * 3
    table = spark.createDataFrame(rows, "g string, v bigint")
    got = {r.g: tuple(r)[1:] for r in nearest_rank(table.where("g is not null"), ["g"], "v", NAMES).collect()}
    for group in {g for g, _ in rows if g}:
        values = sorted(v for g, v in rows if g == group and v is not None)
        expected = tuple(values[(len(values) * p + 99) // 100 - 1] for p in NAMES.values()) if values else None
        assert got.get(group) == expected, group


def test_equals_the_built_in(spark):
    table = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(600_000)).alias("v"))
    pct = [F.expr(f"percentile_disc({p / 100}) within group (order by v)").cast("bigint").alias(n) for n, p in NAMES.items()]
    expected = table.groupBy("g").agg(*pct)
    assert sorted(nearest_rank(table, ["g"], "v", NAMES).collect()) == sorted(expected.collect())


def test_no_buffer_per_group(spark):
    plan = nearest_rank(spark.range(9).selectExpr("id % 2 as g", "id as v"), ["g"], "v", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan and "ObjectHashAggregate" not in plan


def test_empty(spark):
    assert nearest_rank(spark.range(0).selectExpr("id as g", "id as v"), ["g"], "v", NAMES).count() == 0
