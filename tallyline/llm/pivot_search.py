"""Exact top-k inner products with a pivot-distance index.

Vectors are turned into whole numbers, floor(scale * x). Distances are angles, which obey
the triangle inequality whatever the lengths of the vectors.

Index: every vector is keyed by its nearest pivot and its angle from it. The angles from a
pivot are cut into rings (annuli). The directory keeps, for every ring, the smallest and
largest angle of its vectors from each of the pivots, and their lengths: it has
`PIVOTS * RINGS` rows at any size of data.

Search: if a query is at angle d from a pivot and a ring at [low, high], the ring's vectors
are at least low - d and d - high away; the largest of these gaps over all pivots, with the
ring's lengths, bounds every inner product in it. A query's rings are sorted by that bound
and expanded in rounds: `FIRST` rings, then four times as many, and so on. After a round
the k-th best score found so far is the limit of the next one, and a query stops at the
first ring whose bound is below its limit. A bounded sample of the vectors gives the
first limit. A round reads only rings that some query expands.

Pivots and rings are fitted on the sample; every vector is indexed, so results are exact.
Rings are worked on in blocks of about `BLOCK` vectors: small rings share a block, one that
a large cluster fills is cut into many.

Cases: vectors that are null, or hold a null, NaN or infinity, and rows without id take no
part; every row is a candidate, so an id with several rows may be found several times; rows
with the query's id are its own, and where several rows are queries of one id, the best
pairs of all of them count; shorter vectors count as if ended by zeros; with fewer
candidates than k all are returned; ties go to the smaller id; an empty table gives an
empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyline.llm.common import Scratch, hash_order, least_hashed

SCALE = 256
TOP = 5
PIVOTS = 256
RINGS = 4
# Vectors that pivots, rings and the queries' first limits are taken from.
SAMPLE = 2048
BLOCK = 512
# Queries compared with a block at once.
QUERY_BLOCK = 2048
# Rings that a query expands in the first round; each further round takes WIDER times as many.
FIRST, WIDER = 32, 4
# Of rounding in angles (arc cosines near 1 are off by 1e-7), as a share of the product of two lengths.
SLACK = 1e-6
LEAST = -(1 << 63)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)


class Space(NamedTuple):
    """How vectors are stored, and the largest square of their lengths."""

    dims: int
    kind: str
    length2: float

    def matrix(self, packed) -> np.ndarray:
        """Rows of packed vectors; floats hold their products exactly, else Python's whole numbers do."""
        found = np.frombuffer(b"".join(packed), self.kind).reshape(-1, self.dims)
        return found.astype(np.float64 if self.length2 < 2**53 else object)


class Index(NamedTuple):
    space: Space
    pivots: np.ndarray  # of length 1
    edges: np.ndarray  # inner ring borders of every pivot
    sample_ids: np.ndarray
    sample: np.ndarray


class Directory(NamedTuple):
    """Per ring: its number, size, angles from each pivot, lengths, first block and number of blocks."""

    cells: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray
    block: np.ndarray
    blocks: np.ndarray


def directions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors brought to length 1, and their lengths. A vector of zeros stays one: any angle is right for it."""
    points = matrix.astype(np.float64)
    lengths = np.sqrt((points * points).sum(axis=1))
    return points / np.where(lengths > 0, lengths, 1.0)[:, None], lengths


def angles(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ pivots.T, -1.0, 1.0))


def packed(rows: DataFrame, space: Space) -> DataFrame:
    """(vec_id, n, v) with the vector as bytes; `n` rows are alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["v"]:
                whole = np.zeros(space.dims, space.kind)
                whole[: len(v)] = v
                out.append(whole.tobytes())
            yield pd.DataFrame({"vec_id": batch["vec_id"], "n": batch["n"], "v": out})

    return rows.mapInPandas(run, "vec_id long, n long, v binary")


def fitted(sample: pd.DataFrame, space: Space, pivots: int, rings: int) -> Index:
    """Pivots far from each other, and ring borders at even shares of the sample."""
    matrix = space.matrix(sample["v"])
    points, _ = directions(matrix)
    chosen = [0]
    nearest = angles(points, points[:1])[:, 0]
    while len(chosen) < min(pivots, len(points)) and nearest.max() > 1e-6:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(points, points[chosen[-1:]])[:, 0])
        nearest[chosen[-1]] = 0.0
    far = angles(points, points[chosen])
    of = far.argmin(axis=1)
    shares = np.arange(1, rings) / rings
    edges = [np.quantile(far[of == p, p] if (of == p).any() else [0.0], shares) for p in range(len(chosen))]
    return Index(space, points[chosen], np.array(edges), sample["vec_id"].to_numpy(), matrix)


def keyed(vectors: DataFrame, index: Index) -> DataFrame:
    """(vec_id, n, v, cell): the ring of the nearest pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rings = index.edges.shape[1] + 1
        for batch in batches:
            if len(batch):
                far = angles(directions(index.space.matrix(batch["v"]))[0], index.pivots)
                pivot = far.argmin(axis=1)
                own = far[np.arange(len(far)), pivot]
                ring = (index.edges[pivot] <= own[:, None]).sum(axis=1)
                yield batch.assign(cell=(pivot * rings + ring).astype(np.int32))

    return vectors.mapInPandas(run, "vec_id long, n long, v binary, cell int")


def ranges(vectors: DataFrame, index: Index) -> DataFrame:
    """(cell, pivot, low, high, size): the angles of every ring's vectors from every pivot.

    The row of pivot -1 holds lengths instead. Vectors are sorted by ring, so that a task
    has few of them; its rows meet those of other tasks as minima and maxima.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            points, lengths = directions(index.space.matrix(batch["v"]))
            far = np.column_stack([lengths, angles(points, index.pivots)])
            for cell, rows in batch.groupby("cell").indices.items():
                low, high, size = far[rows].min(axis=0), far[rows].max(axis=0), len(rows)
                if cell in known:
                    low, high = np.minimum(low, known[cell][0]), np.maximum(high, known[cell][1])
                    size += known[cell][2]
                known[cell] = low, high, size
        pivots = np.arange(-1, len(index.pivots), dtype=np.int32)
        for cell, (low, high, size) in known.items():
            yield pd.DataFrame({"cell": np.int32(cell), "pivot": pivots, "low": low, "high": high, "size": size})

    found = vectors.mapInPandas(run, "cell int, pivot int, low double, high double, size long")
    return found.groupBy("cell", "pivot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size")
    )


def directory_of(found: pd.DataFrame, block: int) -> Directory:
    """The directory from its `ranges`. Small rings share a block until it is full, large ones have several."""
    found = found.sort_values(["cell", "pivot"])
    cells = found["cell"].unique()
    low = found["low"].to_numpy().reshape(len(cells), -1)
    high = found["high"].to_numpy().reshape(len(cells), -1)
    sizes = found["size"].to_numpy().reshape(len(cells), -1)[:, 0]
    first, blocks, at, held = [], [], 0, 0
    for size in sizes:
        if held and held + size > block:
            at, held = at + 1, 0
        first.append(at)
        blocks.append(max(1, -(-int(size) // block)))
        held += int(size)
        if blocks[-1] > 1:
            at, held = at + blocks[-1], 0
    return Directory(
        cells, sizes, low[:, 1:], high[:, 1:], low[:, 0], high[:, 0], np.array(first), np.array(blocks)
    )


def with_first_limit(queries: DataFrame, index: Index, top: int) -> DataFrame:
    """(query_id, n, v, floor): the k-th best score among the sample, the least there is without k of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, matrix = batch["vec_id"].to_numpy(), index.space.matrix(batch["v"])
            floor = []
            for query_id, scores in zip(ids, matrix @ index.sample.T):
                others = scores[index.sample_ids != query_id]
                floor.append(int(np.sort(others)[-top]) if len(others) >= top else LEAST)
            yield pd.DataFrame({"query_id": ids, "n": batch["n"], "v": batch["v"], "floor": floor})

    return queries.mapInPandas(run, "query_id long, n long, v binary, floor long")


def bounds(points: np.ndarray, lengths: np.ndarray, index: Index, directory: Directory) -> np.ndarray:
    """Of every query (row) and ring: no inner product between them is larger."""
    far = angles(points, index.pivots)
    gap = np.zeros((len(points), len(directory.cells)))
    for p in range(far.shape[1]):
        own = far[:, p, None]
        np.maximum(gap, np.maximum(directory.low[:, p] - own, own - directory.high[:, p]), out=gap)
    cosine = np.cos(gap)
    widest = lengths[:, None] * directory.most
    return widest * SLACK + cosine * np.where(cosine >= 0, widest, lengths[:, None] * directory.least)


def expanded(queries: DataFrame, index: Index, directory: Directory, start: int, end: int) -> DataFrame:
    """(query_id, n, v, floor, cells, block) of the rings that queries (query_id, n, v, floor) expand in a round.

    These are the rings from place `start` to `end` in the order of a query's bounds, up
    to the first below its limit; those of one block come in one row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            points, lengths = directions(index.space.matrix(batch["v"]))
            for row, bound in zip(batch.itertuples(), bounds(points, lengths, index, directory)):
                order = np.argsort(-bound, kind="stable")[start:end]
                order = order[bound[order] >= row.floor]
                per_block: dict[int, list[int]] = {}
                for place in order:
                    for b in range(directory.block[place], directory.block[place] + directory.blocks[place]):
                        per_block.setdefault(int(b), []).append(int(directory.cells[place]))
                out += [(row.query_id, row.n, row.v, row.floor, cells, b) for b, cells in per_block.items()]
            yield pd.DataFrame(out, columns=["query_id", "n", "v", "floor", "cells", "block"])

    return queries.mapInPandas(run, "query_id long, n long, v binary, floor long, cells array<int>, block int")


def best_in_block(space: Space, top: int):
    """The best candidates of one block for each query that expands a ring of it, as far as its limit lets them count."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("vec_id")
            ids, cell, alike = (vectors[c].to_numpy() for c in ("vec_id", "cell", "n"))
            asked, times = queries["query_id"].to_numpy(), queries["n"].to_numpy()
            scores = space.matrix(queries["v"]) @ space.matrix(vectors["v"]).T
            looked_at = np.stack([np.isin(cell, cells) for cells in queries["cells"]])
            looked_at &= asked[:, None] != ids[None, :]
            looked_at &= (scores >= queries["floor"].to_numpy()[:, None]).astype(bool)
            scores[~looked_at] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
            rows = np.repeat(np.arange(len(asked)), order.shape[1])
            columns = order.ravel()
            valid = looked_at[rows, columns]
            rows, columns = rows[valid], columns[valid]
            # rows alike are pairs of their own, of which no more than `top` can count
            pairs = np.minimum(np.minimum(alike[columns], top) * np.minimum(times[rows], top), top)
            rows, columns = np.repeat(rows, pairs), np.repeat(columns, pairs)
            found = pd.DataFrame({"query_id": asked[rows], "vec_id": ids[columns]})
            out.append(found.assign(score=scores[rows, columns].astype(np.int64)))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return run


def search(
    rows: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE, pivots: int = PIVOTS, rings: int = RINGS,
    sample: int = SAMPLE, block: int = BLOCK, first: int = FIRST, compared: list[int] | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `top` best vectors of `rows` (vec_id, embedding) for each query.

    `compared` gets the number of pairs looked at in each round, at the cost of a count.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "pivots")
    found = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    found = found.select(F.col("vec_id").cast("long"), whole_numbers(F.col("embedding"), scale).alias("v"))
    found = scratch.keep(found.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "numbers")
    most = F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0)))))
    facts = found.agg(F.max(F.size("v")), most, F.max(square(F.col("v")))).first()
    if facts[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = next(k for k in ("<i2", "<i4", "<i8") if facts[1] <= np.iinfo(k).max)
    space = Space(max(1, facts[0]), kind, float(facts[2]))

    vectors = packed(found, space)
    index = fitted(least_hashed(vectors, sample, "vec_id").toPandas(), space, pivots, rings)
    # files hold few rings each, so that a round can leave files out
    by_ring = keyed(vectors, index).repartitionByRange("cell", hash_order("vec_id")).sortWithinPartitions("cell")
    vectors = scratch.keep(by_ring, "vectors")
    directory = directory_of(ranges(vectors, index).toPandas(), block)  # pivots² * rings rows at most
    places = [(int(c), int(b), int(n)) for c, b, n in zip(directory.cells, directory.block, directory.blocks)]
    of_cell = F.broadcast(spark.createDataFrame(places, "cell int, block_0 int, blocks int"))
    own_block = F.col("block_0") + F.pmod(hash_order("vec_id", "v"), F.col("blocks")).cast("int")
    vectors = vectors.join(of_cell, "cell").select("vec_id", "n", "v", "cell", own_block.alias("block"))

    queries = found.where(is_query)
    queries = scratch.keep(with_first_limit(packed(queries, space), index, top), "queries")
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    part = F.pmod(hash_order("query_id", "v"), F.lit(parts)).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    start, end = 0, first
    while start < len(directory.cells):
        tighter = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n_best"))
        limit = F.when(F.col("n_best") >= top, F.greatest("floor", "kth")).otherwise(F.col("floor"))
        asking = queries.join(tighter, "query_id", "left").select("query_id", "n", "v", limit.alias("floor"))
        visits = scratch.keep(expanded(asking, index, directory, start, end).withColumn("part", part), "visits")
        if visits.isEmpty():
            break  # bounds only fall and limits only rise: later rings are of no use either
        if compared is not None:
            sizes = spark.createDataFrame(list(zip(directory.cells.tolist(), directory.sizes.tolist())), "cell int, size long")
            # a ring of several blocks has a row in each, and counts once
            seen = visits.select("query_id", "v", F.explode("cells").alias("cell")).distinct().join(sizes, "cell")
            compared.append(seen.agg(F.sum("size")).first()[0])
        # named anew: the two sides of the cogroup share their origin
        named = [F.col(c).alias(c) for c in ("block", "part")]
        wanted = visits.select(*named, F.explode("cells").alias("cell")).distinct()
        left = vectors.join(wanted, ["cell", "block"])
        keys = ["block", "part"]
        new = left.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(
            best_in_block(space, top), "query_id long, vec_id long, score long"
        )
        ranked = best.unionByName(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        best = scratch.keep(ranked.drop("rank"), "best")
        start, end = end, end + (end - start) * WIDER
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
