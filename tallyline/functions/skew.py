"""Joins and counts that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy above this share of all rows. At most 1/HEAVY_SHARE keys can
# be heavy whatever the data, so the set of heavy keys is safe to broadcast.
HEAVY_SHARE = 1e-4
# Below this many rows a key is never heavy: one task handles it easily.
HEAVY_FLOOR = 1_000_000
MOST_HEAVY = 10_000
# Keys that a sketch tells apart. Its counts are off by 2.7 / TRACKED of all rows at most,
# so no key with more than HEAVY_SHARE of them escapes.
TRACKED = 65_536
# Sketches of one pass are merged in so many tasks before they meet.
MERGED_IN = 64
SALTS = 64
# Between the parts of a key in a sketch. A key that holds it is not recognised, and so never heavy.
_BETWEEN = "\x1f"


def key_sketches(events: DataFrame, *key_sets: list[str]) -> DataFrame:
    """(key_name, rows, sketch): frequent-items sketches of several keys, in one pass that moves no keys.

    The table is small (MERGED_IN rows per key) and mergeable: those of several loads can be
    kept beside the stored events, and their union given to `HeavyKeys`.
    """
    sums = []
    for keys in key_sets:
        text = F.concat(*[x for k in keys for x in (F.lit(_BETWEEN), F.col(k).cast("string"))])
        events = events.withColumn(f"sketched_{keys[-1]}", text)
        name = f"`sketched_{keys[-1]}`"
        sums.append(F.expr(f"approx_top_k_accumulate({name}, {TRACKED}) FILTER (WHERE {name} IS NOT NULL)").alias(f"s_{keys[-1]}"))
        sums.append(F.count(F.col(name)).alias(f"n_{keys[-1]}"))
    some = events.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGED_IN)).alias("part")).agg(*sums)
    rows = [
        F.struct(F.lit(k[-1]).alias("key_name"), F.col(f"n_{k[-1]}").alias("rows"), F.col(f"s_{k[-1]}").alias("sketch"))
        for k in key_sets
    ]
    return some.select(F.inline(F.array(*rows))).where("rows > 0")


class HeavyKeys:
    """Heavy keys of one event table, looked up once per key and usually absent.

    Found by frequent-items sketches, without an exact count per key. Some keys a little
    below the share may be taken for heavy: that changes a plan, not a result. `of` answers
    None when no key is heavy, so that ordinary data gets the plain plan. `kept` are sketches
    stored with the events (`key_sketches`); keys they lack are sketched here.
    """

    def __init__(self, events: DataFrame, kept: DataFrame | None = None):
        self.events, self.kept = events, kept
        self.known: dict[tuple[str, ...], DataFrame | None] = {}
        self.n_rows: int | None = None

    def look_up(self, *key_sets: list[str]) -> HeavyKeys:
        """Look several keys up in one pass over the events. All share the leading tenant columns."""
        new = [k for k in map(tuple, key_sets) if k not in self.known]
        if not new:
            return self
        if self.kept is None and self.n_rows is None:
            self.n_rows = self.events.count()
        if self.kept is None and self.n_rows <= HEAVY_FLOOR:
            self.known |= dict.fromkeys(new)  # too few rows for any heavy key
            return self
        stored = self.kept if self.kept is not None else key_sketches(self.events, *new)
        merged = stored.groupBy("key_name").agg(
            F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")
        )
        top = F.explode(F.expr(f"approx_top_k_estimate(sketch, {MOST_HEAVY})")).alias("top")
        heavy = (F.col("top.count") > HEAVY_FLOOR) & (F.col("top.count") > F.col("rows") * HEAVY_SHARE)
        # MOST_HEAVY rows per key at most
        found = merged.select("key_name", "rows", top).where(heavy).select("key_name", "top.item").collect()
        for keys in new:
            own = [tuple(r.item.split(_BETWEEN)[1:]) for r in found if r.key_name == keys[-1]]
            own = [row for row in own if len(row) == len(keys)]
            types = [self.events.schema[k].dataType for k in keys]
            table = self.events.sparkSession.createDataFrame(own, ", ".join(f"`{k}` string" for k in keys)) if own else None
            self.known[keys] = table and table.select(*[F.col(k).cast(t) for k, t in zip(keys, types)])
        return self

    def of(self, keys: list[str]) -> DataFrame | None:
        return self.look_up(keys).known[tuple(keys)]


def split_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str, heavy: DataFrame | None
) -> DataFrame:
    """Join on `keys`, unique in `small`; rows of heavy keys meet `small` by broadcast.

    The broadcast part of `small` holds at most one row per heavy key.
    """
    if heavy is None:
        return big.join(small, keys, how)
    marked = F.broadcast(heavy.withColumn("is_heavy", F.lit(True)))
    of_big = big.join(marked, keys, "left")
    of_small = small.join(marked, keys, "left")
    ordinary = F.col("is_heavy").isNull()
    spread = of_big.where(ordinary).drop("is_heavy").join(of_small.where(ordinary).drop("is_heavy"), keys, how)
    local = (
        of_big.where(~ordinary).drop("is_heavy").join(F.broadcast(of_small.where(~ordinary).drop("is_heavy")), keys, how)
    )
    return spread.unionByName(local)


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: Column, how: str = "inner"
) -> DataFrame:
    """Join with a table of a few rows per tenant: every row is copied once per salt.

    For joins on the tenant alone, where a single tenant is always heavy.
    """
    salted = big.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "salt"], how).drop("salt")
