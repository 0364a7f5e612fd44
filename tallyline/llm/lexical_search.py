"""Exact ranked lexical search: inner products by sparse ball trees.

Queries and documents are sparse vectors over the queries' terms. A document's value
of a term is its saturated count, a query's value its count times the term's weight,
and the score is their inner product, in 64-bit integers throughout.

Every task cuts its documents into blocks and builds a ball tree of each: a node has
the centroid of its documents and the radius around it. All documents of a node lie
in the subspace of the node's own terms, so no score can exceed <q, centroid> plus
the radius times the length of the query in that subspace. Nodes are scored in the
order of this bound, and a query is done with a tree once the best bound left is
below its k-th score. Bounds are floating point, rounded up by more than their error;
leaves are scored exactly. The best scores of a task's earlier blocks go on to its
later ones; the best of all tasks are ranked at the end.

The geometry is that of the documents scaled by powers of the terms' weights, and the
queries scaled by the inverse: inner products stay, balls get tighter.

Queries come in blocks of bounded size, each against all documents. What a task holds
is one block of queries and one block of documents; texts are read once per block of
queries and never shuffled.

Cases: a null or empty text, or one without terms, isn't counted as a document and is
never found, as a query it finds nothing; equal rows of queries are one query, rows
that only share an id are queries of their own; documents of equal id are documents of
their own, those without id count and come last among equal scores; empty tables give
an empty result. Only ids and texts are read, whatever else the tables hold.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import Scratch, give_back, small_batches

TOP = 20
# A block of queries: so many rows and characters, about.
QUERIES, QUERY_CHARS = 8192, 1 << 21
# A block of documents: so many rows or entries at most (a single row may have more).
ROWS, ENTRIES = 1 << 13, 1 << 21
LEAF = 16
# Parts of the vector space that have radii of their own.
BANDS = 256
# Queries whose bounds are computed together, and the cells of their matrix.
GROUP, CELLS = 256, 1 << 22
# Relative error allowed to the floating point bounds; theirs is some 1e-12.
SLACK = 1e-9

# Terms are runs of ASCII letters and digits and of everything beyond ASCII. On UTF-8
# bytes: other ASCII characters become blanks, A-Z small letters.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


class Query(NamedTuple):
    """A query's terms as increasing numbers, their counts, and its id."""

    item: int | None
    terms: np.ndarray
    counts: np.ndarray


def numbered(rows: list) -> tuple[list[Query], dict[bytes, int]]:
    """The queries of rows (id, text), and the numbers of all their terms."""
    counted = [(item, Counter(terms(text))) for item, text in rows]
    # in an order that has nothing to do with the queries: neighbours make a band
    names = sorted({t for _, c in counted for t in c}, key=lambda t: (crc32(t), t))
    vocabulary = {t: i for i, t in enumerate(names)}
    found = []
    for item, of_term in counted:
        counts = {vocabulary[t]: n for t, n in of_term.items()}
        ids = sorted(counts)
        found.append(Query(item, np.array(ids, np.int64), np.array([counts[t] for t in ids], np.int64)))
    return found, vocabulary


VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every document's number of terms, and its counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, counts = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                hits = Counter(filter(None, map(number, found)))
                n.append(len(found))
                ids.append(list(hits))
                counts.append(list(hits.values()))
            arrays = [batch.column(0), pa.array(n, pa.int64())]
            # numbers start at 0, but 0 is what filter() takes for nothing: they are moved by one
            arrays.append(pa.array([[i - 1 for i in x] for x in ids], pa.list_(pa.int32())))
            arrays.append(pa.array(counts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "counts"])
        give_back()

    number = {t: i + 1 for t, i in vocabulary.items()}.get
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(run, VECTORS)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Rows(NamedTuple):
    """Sparse documents: ids, and the terms and values of row i from starts[i] to starts[i + 1]."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def only(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(self.ids[rows], starts, self.terms[at], self.values[at])


class Node(NamedTuple):
    """An inner node: its children, their terms together, their centroids there, their radii by band."""

    children: tuple
    terms: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray


class Leaf(NamedTuple):
    """Documents as a dense matrix over their own terms."""

    ids: np.ndarray
    terms: np.ndarray
    values: np.ndarray


class Ball(NamedTuple):
    child: Node | Leaf
    terms: np.ndarray
    centroid: np.ndarray
    radii: np.ndarray


def ball_tree(rows: Rows, band: np.ndarray, leaf: int = LEAF) -> Ball:
    """The tree of some documents; `band` is each term's band."""
    n = len(rows.ids)
    own, place = np.unique(rows.terms, return_inverse=True)
    values = rows.values.astype(np.float64)
    # rounded first: the radii are those around what is kept
    centroid = (np.bincount(place, values, len(own)) / n).astype(np.float32).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(rows.starts))

    def sums(x: np.ndarray) -> np.ndarray:
        return np.bincount(row * BANDS + band[rows.terms], x, n * BANDS).reshape(n, BANDS)

    # |x - c|^2 by band: summed over x's own terms, then c's part elsewhere
    of_centre, lengths = centroid[place] ** 2, np.bincount(band[own], centroid**2, BANDS)
    apart = sums((values - centroid[place]) ** 2 - of_centre) + lengths
    radii = np.sqrt((np.maximum(apart, 0) + SLACK * (sums(values**2 + of_centre) + lengths)).max(axis=0))
    if n <= leaf:
        dense = np.zeros((n, len(own)), np.int64)
        dense[row, place] = rows.values
        return Ball(Leaf(rows.ids, own, dense), own, centroid, radii)
    # the row farthest from the centre, and the one farthest from that
    space = np.zeros(len(own))
    squares = np.bincount(row, values**2, n)

    def along(i: int) -> np.ndarray:
        part = slice(rows.starts[i], rows.starts[i + 1])
        space[place[part]] = values[part]
        dots = np.bincount(row, values * space[place], n)
        space[place[part]] = 0
        return dots

    first = int(apart.sum(axis=1).argmax())
    to_first = along(first)
    second = int((squares - 2 * to_first).argmax())
    order = np.argsort(along(second) - to_first, kind="stable")
    halves = [ball_tree(rows.only(part), band, leaf) for part in (order[: n // 2], order[n // 2 :])]
    centroids = np.zeros((2, len(own)), np.float32)
    for k, half in enumerate(halves):
        centroids[k, np.searchsorted(own, half.terms)] = half.centroid
    return Ball(Node(tuple(h.child for h in halves), own, centroids, np.array([h.radii for h in halves])), own, centroid, radii)


def places(own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `wanted` are among `own`, both increasing, and where."""
    place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    mine = np.flatnonzero(own[place] == wanted)
    return mine, place[mine]


class Best:
    """A query with its best (score, -id, id) so far, the least first."""

    def __init__(self, query: Query, weight: np.ndarray, k: int):
        self.k, self.terms = k, query.terms
        self.values = query.counts * weight[query.terms]
        self.found: list[tuple[int, int, int]] = []
        self.scored = 0

    def score(self, leaf: Leaf) -> None:
        mine, place = places(leaf.terms, self.terms)
        scores = leaf.values[:, place] @ self.values[mine]
        self.scored += len(scores)
        least = self.found[0][0] if len(self.found) == self.k else 1
        for i in np.flatnonzero(scores >= least):
            doc = int(leaf.ids[i])
            entry = (int(scores[i]), -doc, doc)
            if len(self.found) < self.k:
                heapq.heappush(self.found, entry)
            elif entry > self.found[0]:
                heapq.heapreplace(self.found, entry)


class Group:
    """Queries whose bounds are computed together, for the nodes that any of them opens."""

    def __init__(self, queries: list[Best], band: np.ndarray):
        self.queries = queries
        self.terms = np.unique(np.concatenate([q.terms for q in queries]))
        self.band = band[self.terms]
        self.values = np.zeros((len(self.terms), len(queries)))
        for k, q in enumerate(queries):
            self.values[np.searchsorted(self.terms, q.terms), k] = q.values
        self.squares = self.values**2

    def bounds(self, node: Node) -> np.ndarray:
        """No document of a child scores more than this, by child and query."""
        mine, place = places(node.terms, self.terms)
        if not len(mine):
            return np.zeros((2, len(self.queries)))
        centroids = node.centroids[:, place].astype(np.float64)
        bounds = centroids @ self.values[mine]
        bands, starts = np.unique(self.band[mine], return_index=True)
        squares = self.squares[mine]
        for k in range(2):
            # a centroid is zero where no document has the term
            inside = np.add.reduceat(squares * (centroids[k] > 0)[:, None], starts, axis=0)
            bounds[k] += node.radii[k, bands] @ np.sqrt(inside)
        return bounds * (1 + SLACK)

    def search(self, tree: Ball) -> None:
        known: dict[int, np.ndarray] = {}
        for k, query in enumerate(self.queries):
            frontier: list[tuple[float, int, Node | Leaf]] = [(-math.inf, 0, tree.child)]
            n = 0
            while frontier:
                bound, _, node = heapq.heappop(frontier)
                # equal scores of smaller ids may still come
                if len(query.found) == query.k and -bound < query.found[0][0]:
                    break
                if isinstance(node, Leaf):
                    query.score(node)
                    continue
                if id(node) not in known:
                    known[id(node)] = self.bounds(node)
                for child, b in zip(node.children, known[id(node)][:, k].tolist()):
                    if b > 0:
                        n += 1
                        heapq.heappush(frontier, (-b, n, child))


def grouped(queries: list[Best], band: np.ndarray) -> list[Group]:
    """The queries in groups whose matrices have a bounded size."""
    groups: list[list[Best]] = [[]]
    n = 0
    for query in queries:
        n += len(query.terms)
        if groups[-1] and (len(groups[-1]) == GROUP or n * (len(groups[-1]) + 1) > CELLS):
            groups.append([])
            n = len(query.terms)
        if len(query.terms):
            groups[-1].append(query)
    return [Group(g, band) for g in groups if g]


# Documents without id come last among equal scores.
NO_ID = (1 << 63) - 1


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS, entries: int = ENTRIES) -> Iterator[tuple]:
    """(ids, lengths, starts, terms, counts) of blocks of documents (`vectors`)."""
    held: list[tuple] = []

    def joined() -> tuple:
        ids, n, sizes, found, counts = (np.concatenate(x) for x in zip(*held))
        return ids, n, np.concatenate([[0], np.cumsum(sizes)]), found, counts

    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        sizes = pa.compute.list_value_length(table["terms"]).to_numpy()
        ends = np.cumsum(sizes)
        found, counts = (table[c].combine_chunks().flatten().to_numpy() for c in ("terms", "counts"))
        n = table["n"].to_numpy()
        at = 0
        while at < len(ids):
            room = entries - sum(int(h[2].sum()) for h in held)
            before = ends[at - 1] if at else 0
            fits = min(int(np.searchsorted(ends, before + room, "right")), at + rows - sum(len(h[0]) for h in held))
            to = max(fits, at if held else at + 1)
            if to > at:
                held.append((ids[at:to], n[at:to], sizes[at:to], found[before : ends[to - 1]], counts[before : ends[to - 1]]))
            at = to
            if at < len(ids):
                yield joined()
                held = []
    if held:
        yield joined()


FOUND = "query int, doc_id long, score long, scored long"


def best(rows: DataFrame, queries: list[Query], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The `k` best documents of each query in each task, as (query's place, doc_id, score).

    A row without document says how many documents were scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(len(weight)) * BANDS // len(weight)
        heaps = [Best(q, weight, k) for q in queries]
        groups = grouped(heaps, band)
        for ids, n, starts, found, counts in blocks(batches):
            m = 75 + 25 * n * n_docs // n_terms
            tf = counts.astype(np.int64)
            values = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(starts)))
            tree = ball_tree(Rows(ids, starts, found.astype(np.int64), values), band)
            for group in groups:
                group.search(tree)
        out = [(i, d if d != NO_ID else None, s, None) for i, h in enumerate(heaps) for s, _, d in h.found]
        out += [(i, None, None, h.scored) for i, h in enumerate(heaps) if h.scored]
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "doc_id", "score", "scored"])
        give_back()

    return rows.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(run, FOUND)


def in_blocks(queries: DataFrame) -> Iterator[list]:
    """The distinct rows (id, text) of the queries, one bounded block at a time."""
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(-(-size["n"] // QUERIES), -(-size["chars"] // QUERY_CHARS))
    for block in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(docs: DataFrame, queries: DataFrame, top: int = TOP) -> Iterator[tuple[DataFrame, DataFrame, int]]:
    """For each block of queries: its result, the number of documents scored per query, and all documents."""
    scratch = Scratch(docs.sparkSession, "lexical")
    for rows in in_blocks(queries):
        items, vocabulary = numbered(rows)
        table = scratch.keep(vectors(docs, vocabulary), "vectors")
        total = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total["docs"] or not vocabulary:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        found = best(table, items, weights(df, total["docs"]), total["docs"], total["terms"], top)
        found = scratch.keep(found, "found")
        ids = docs.sparkSession.createDataFrame([(i, q.item) for i, q in enumerate(items)], "query int, item_id long")
        result = ranked(found.where("score is not null"), top).join(F.broadcast(ids), "query")
        yield result.select("item_id", "rank", "doc_id", "score"), found.where("scored is not null"), total["docs"]


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of every query with a score above 0."""
    results = [result for result, _, _ in searched(docs, queries, top)]
    nothing = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results, nothing)


def share_scored(docs: DataFrame, queries: DataFrame, top: int = TOP) -> float:
    """How much of all documents' scores was computed; the bounds spared the rest."""
    parts = [(scored.agg(F.sum("scored")).first()[0] or 0, n * scored.count()) for _, scored, n in searched(docs, queries, top)]
    return sum(a for a, _ in parts) / max(1, sum(b for _, b in parts))

