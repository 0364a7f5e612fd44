"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

A 64-bit SimHash is made of every text. Two fingerprints link when they differ
in at most `RADIUS` bits, and a group is what links reach.

Candidates come from covering masks. Bit position i gets a nonzero vector m(i)
of RADIUS + 1 bits, and the mask of each nonzero vector v keeps the positions
where <m(i), v> is odd. The vectors of RADIUS differing positions span less
than the whole space, so some v is orthogonal to all of them: in that mask's
table the pair has equal keys. No pair within the radius is missed.

Cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; texts of one or two words have one shingle; equal texts
have one fingerprint; a row without id gets a fingerprint but takes no part in
linking (its component is null); an empty table gives an empty result. Only the
id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import Scratch, small_batches

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# A table key shared by more fingerprints than this is cut into smaller keys.
GROUP = 2048
# Shingles whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint_of(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned number."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    size = min(size, len(found))
    shingles = zip(starts, ends[size - 1 :], strict=False)
    hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], seed) for a, b in shingles), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    over_half = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(over_half.view("<u8")[0])


def simhash(text: Column) -> Column:
    """SimHash of a text column, its 64 bits as a long."""

    @F.pandas_udf(T.LongType())
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return of_texts(text)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask per nonzero vector of radius + 1 bits."""
    vectors = range(1, 1 << (radius + 1))
    of_bit = [1 + i % len(vectors) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (of_bit[i] & v).bit_count() % 2) for v in vectors]


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def parts_of(free: int, parts: int = RADIUS + 1) -> list[int]:
    """The free positions dealt to one part more than bits may differ: one part is equal."""
    positions = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for i in positions[k::parts]) for k in range(parts)]


def finer_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, fp, free) of crowded keys, each under RADIUS + 1 smaller keys.

    Fingerprints of one key agree outside `free`. Of the parts of `free` one is
    equal for every pair within the radius, so key and part make the new key.
    """
    from xxhash import xxh64_intdigest

    for batch in batches:
        out = []
        for free, rows in batch.groupby("free", sort=False):
            for k, part in enumerate(parts_of(int(free) % (1 << 64))):
                fixed = rows["fp"].to_numpy() & np.int64(signed(part))
                packed = np.stack([rows["key"].to_numpy(), fixed], axis=1)
                keys = [signed(xxh64_intdigest(row.tobytes(), k)) for row in packed]
                rest = signed((int(free) % (1 << 64)) & ~part)
                out.append(pd.DataFrame({"key": keys, "fp": rows["fp"].to_numpy(), "free": rest}))
        if out:
            yield pd.concat(out, ignore_index=True)


def links_in_groups(radius: int):
    """For rows sorted by key: each fingerprint with the smallest one its group's links reach."""

    def stars(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        parent = np.arange(len(fp))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        bits = fp.view(np.uint64)
        for step in range(1, len(fp)):
            together = key[step:] == key[:-step]
            if not together.any():
                break
            near = np.flatnonzero(together & (np.bitwise_count(bits[step:] ^ bits[:-step]) <= radius))
            while (parent != parent[parent]).any():
                parent = parent[parent]
            for i in near[parent[near] != parent[near + step]]:
                a, b = root(i), root(i + step)
                parent[max(a, b)] = min(a, b)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        linked = parent != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked], "b": fp[parent[linked]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key, fp = np.append(key, batch["key"].to_numpy()), np.append(fp, batch["fp"].to_numpy())
            if len(key):
                whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                yield stars(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        yield stars(key, fp)

    return run


def covering_links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of `fps.fp` (distinct) within the radius.

    Keys of one fingerprint are dropped. Keys of more than `group` fingerprints
    are cut along their free bits until all fit; as fingerprints are distinct,
    the free bits run out, so this ends. In each group links become a star.
    """
    masks = covering_masks(radius)
    tables = [
        F.struct(
            F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key"),
            F.col("fp"),
            F.lit(signed(~m % (1 << BITS))).cast("long").alias("free"),
        )
        for n, m in enumerate(masks)
    ]
    rows = fps.select(F.inline(F.array(*tables)))
    found: DataFrame | None = None
    while True:
        shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kept = scratch.keep(rows.join(shared, "key"), "keys")
        small = kept.where(F.col("n") <= group).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        links = small.mapInPandas(links_in_groups(radius), "a long, b long").distinct()
        found = links if found is None else found.unionByName(links)
        crowded = kept.where(F.col("n") > group).select("key", "fp", "free")
        if crowded.isEmpty():
            return scratch.keep(found.distinct(), "links")
        rows = crowded.mapInPandas(finer_keys, "key long, fp long, free long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in `links` (a, b), root the smallest node it reaches.

    Alternating stars: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows. Minima combine before the shuffle and
    meet the edges in a join, so a node with very many links is split as a join is.
    """

    def towards_minimum(edges: DataFrame, up: bool) -> DataFrame:
        if up:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = edges.groupBy("a").agg(F.min("b").alias("m"))
            own = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = own.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    larger = F.greatest("a", "b").alias("a")
    edges = links.where("a <> b").select(larger, F.least("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges, "edges")
    seen = state(edges)
    while seen[0]:
        edges = scratch.keep(towards_minimum(towards_minimum(edges, True), False), "edges")
        scratch.drop("edges", scratch.paths["edges"] - 1)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(small_batches(docs).select("doc_id", simhash(F.col("text")).alias("fp")), "fingerprints")
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = covering_links(nodes.select("fp"), scratch, radius, group)
    roots = components(links, scratch).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    named = marked.join(classes, "fp", "left")
    return named.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_of(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without near-duplicates: of each group the row of the smallest id stays.

    Rows without id stay. Of rows with the same id one stays.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
