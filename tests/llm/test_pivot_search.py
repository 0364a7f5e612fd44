"""Search against brute force, with clusters, ties and odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from compare import difference, oracle_connection
from conftest import DATA
from pyspark.sql import functions as F

from tallyline.llm import pivot_search as ps
from tallyline.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute(rows, every, top):
    whole = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for q in {vec_id for vec_id, _ in whole if vec_id % every == 0}:
        own = [v for vec_id, v in whole if vec_id == q]
        scores = [(-sum(x * y for x, y in zip(a, b)), c) for a in own for c, b in whole if c != q]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(a, None if b is None else list(map(lambda x: x, b)), 1, "x") for a, b in rows], SCHEMA)


def found(spark, rows, every, **more):
    got = ps.search(table(spark, rows), F.col("vec_id") % every == 0, **more).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[rng.integers(6)] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    return rows + [(n + i, same) for i in range(60)]  # ties: one vector many times


@pytest.mark.parametrize("sample", [5, 64, 2048])
def test_equals_brute_force(spark, sample):
    rows = clustered(700, 1)
    got = found(spark, rows, 20, sample=sample, pivots=5, rings=4, block=50)
    assert got == brute(rows, 20, 5)


def test_rounds_leave_most_pairs_out(spark):
    rows = clustered(2000, 2)
    compared = []
    got = found(spark, rows, 50, pivots=32, rings=8, first=4, sample=64, compared=compared)
    assert got == brute(rows, 50, 5)
    assert len(compared) >= 2 and sum(compared) < 0.5 * 41 * len(rows)


def test_limits_tighten_from_round_to_round(spark, monkeypatch):
    """Without a first limit, only the scores of the rings expanded first can spare the others."""

    def no_limit(queries, index, top):
        return queries.select(F.col("vec_id").alias("query_id"), "n", "v", F.lit(ps.LEAST).alias("floor"))

    monkeypatch.setattr(ps, "with_first_limit", no_limit)
    rows = clustered(1500, 3)
    compared = []
    got = found(spark, rows, 50, pivots=32, rings=4, first=4, sample=64, compared=compared)
    assert got == brute(rows, 50, 5)
    assert sum(compared) < 0.6 * 30 * len(rows)


def test_bounds_hold_for_every_vector(spark):
    rng = np.random.default_rng(4)
    whole = np.floor(256 * rng.normal(size=(400, 6)) * rng.choice([0.1, 1, 9], size=(400, 1)))
    whole[7] = 0
    space = ps.Space(6, "<i4", float((whole**2).sum(axis=1).max()))
    frame = pd.DataFrame({"vec_id": range(400), "n": 1, "v": [x.astype("<i4").tobytes() for x in whole]})
    index = ps.fitted(frame.head(100), space, 12, 3)
    keyed = ps.keyed(spark.createDataFrame(frame, "vec_id long, n long, v binary"), index)
    directory = ps.directory_of(ps.ranges(keyed, index).toPandas(), 50)
    bound = ps.bounds(*ps.directions(whole), index, directory)
    place = {int(c): n for n, c in enumerate(directory.cells)}
    for r in keyed.collect():
        assert (whole @ whole[r.vec_id] <= bound[:, place[r.cell]]).all()


def test_ids_that_repeat(spark):
    """Every row is a candidate; a vector that very many rows share is spread over blocks by its id."""
    rows = [(i % 40, [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    rows += [(3, [9.0, 9.0, 9.0])] * 7 + [(0, [1.0, 1.0, 1.0])] * 3
    assert found(spark, rows, 10, block=16, pivots=4, rings=2, first=2) == brute(rows, 10, 5)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (50, [-0.001, 0.5, 3.0]), (1, None), (100, [1.0, None]), (2, [nan, 1.0]), (150, [inf, 0.0]),
        (3, []), (200, []), (None, [1.0, 1.0]), (4, [2.0, 2.0]), (4, [2.0, 2.0]), (5, [0.0, 0.0]), (6, [-3.5, 1.25]), (7, [1e6, 1.0]),
    ]
    assert found(spark, rows, 50) == brute(rows, 50, 5)


def test_huge_components_are_exact(spark):
    rows = [(i, [float(2**21 + 64 * i), float(i * 1000), -float(2**20)]) for i in range(0, 120, 5)]
    assert found(spark, rows, 50) == brute(rows, 50, 5)


def test_fewer_candidates_than_asked(spark):
    assert found(spark, [(0, [1.0]), (50, [2.0]), (1, [3.0])], 50) == brute([(0, [1.0]), (50, [2.0]), (1, [3.0])], 50, 5)
    assert found(spark, [(0, [1.0])], 50) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])], 50) == []
    assert found(spark, [], 50) == []


def test_oracle(spark):
    df = QUERIES["op8_pivot_search"](spark, DATA)
    assert difference(df, oracle_connection(DATA), ORACLES["op8_pivot_search"]) is None
