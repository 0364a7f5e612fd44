"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of the tokens gets a weight in proportion to p ** exponent.
The exponent is bisected between 0 (all sources alike) and 1 (as they are): the
smallest at which no source is repeated more than `max_repeats` times and the
entropy of the weights is `target_entropy` at most (a share of the largest
possible; both limits hold from some exponent on). Without a budget the smallest
one is taken that uses every document at least once.

Weight times budget is a source's quota. Its documents come in permutations, one
per epoch, as often as whole epochs fit the quota, and the last epoch ends where
the quota does. A document's place on its source's quota, as a share, says in
which block of the mixture it falls; inside a block all sources are permuted.

Built-in functions only. Sums along a permutation are taken inside buckets of rows,
over the sums of runs of buckets, and over those of all runs, so a source with most of
the rows is spread. Rows learn of their source's plan where they are: the table of
sources goes to them while it is small, else it is copied under salts.

Cases: a null source is a source of its own; a null or empty text has no tokens
and comes in every epoch; a source without any token is used once, its rows spread
over the blocks by their hash; rows without
id and equal rows count each; an empty table gives an empty result. Only doc_id,
text and source are read for the plan.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.skew import salted_join
from tallyline.llm.common import Scratch, words

MAX_REPEATS = 2.0
TARGET_ENTROPY = 0.95
BLOCK_TOKENS = 1 << 18
SEED = 17
# Documents that are summed up in one window group.
BUCKET = 4096
# Buckets that are summed up in one window group.
RUN = 4096
# Documents in a block, about, if they have few tokens.
BLOCK_ROWS = 1 << 16
# Sources whose plan is broadcast; some 200 bytes each.
MOST_SOURCES = 100_000
# Exponents tried in one pass over the sources: five halvings at a time.
HALVINGS, PASSES = 5, 6
# Weights are whole numbers of this part, so that their sum is exact in any order.
UNIT = 10**12


class Mixture(NamedTuple):
    """`sources` has a row per source: tokens, n_docs, weight, quota, full epochs, rest, buckets."""

    exponent: float
    budget: int
    n_blocks: int
    sources: DataFrame
    n_sources: int


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key, and the tokens (words) of every document."""
    tokens = F.size(words(F.col("text"))).cast("long")
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), tokens.alias("n_tokens"))


def mass(share: Column, exponent: float) -> Column:
    return F.round(F.pow(share, F.lit(exponent)) * UNIT).cast("long")


def bisected(sources: DataFrame, total: int, max_repeats: float, target_entropy: float, budget: int | None) -> float:
    """The smallest exponent within both limits, to a billionth.

    One pass sums the weights for all midpoints of the next five halvings.
    """
    share = F.col("tokens") / F.lit(total)
    rows = sources.where("tokens > 0").select(share.alias("p"))
    low, step = 0.0, 1.0
    for _ in range(PASSES):
        step /= 1 << HALVINGS
        tried = [low + step * k for k in range((1 << HALVINGS) + 1)]
        sums = [F.sum(F.pow("p", F.lit(a))).alias(f"z{k}") for k, a in enumerate(tried)]
        logs = [F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"l{k}") for k, a in enumerate(tried)]
        row = rows.agg(F.min("p").alias("least"), F.max("p").alias("most"), F.count("p").alias("n"), *sums, *logs).first()

        def within(k: int) -> bool:
            a, z = tried[k], row[f"z{k}"]
            entropy = math.log(z) - a * row[f"l{k}"] / z
            if budget is None:
                repeats = (row["most"] / row["least"]) ** (1 - a)
            else:
                repeats = row["least"] ** (a - 1) / z * budget / total
            return repeats <= max_repeats and entropy <= target_entropy * math.log(row["n"]) + 1e-12

        first = bisect_left(range(len(tried)), True, key=within)
        if first == 0 or first == len(tried):
            return round(tried[min(first, len(tried) - 1)], 9)
        low = tried[first - 1]
    return min(1.0, math.ceil((low + step) * 1e9) / 1e9)


def planned(
    rows: DataFrame,
    scratch: Scratch,
    max_repeats: float = MAX_REPEATS,
    target_entropy: float = TARGET_ENTROPY,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> Mixture:
    """Weights, quotas and epochs of the sources of `rows` (from `measured`)."""
    sums = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    sources = scratch.keep(sums, "sources")
    totals = sources.agg(F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("docs"), F.count(F.lit(1)).alias("n")).first()
    total, n_sources = totals["tokens"] or 0, totals["n"]
    least_blocks = max(1, -(-(totals["docs"] or 0) // BLOCK_ROWS))
    if not total:
        whole = sources.select("key", "tokens", "n_docs", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
        return Mixture(1.0, 0, least_blocks, with_epochs(whole), n_sources)
    exponent = bisected(sources, total, max_repeats, target_entropy, budget)
    weighed = sources.withColumn(
        "mass", F.when(F.col("tokens") > 0, mass(F.col("tokens") / F.lit(total), exponent)).otherwise(0)
    )
    z = weighed.agg(F.sum("mass")).first()[0]
    weight = F.col("mass") / F.lit(z)
    if budget is None:
        # the least budget whose quotas hold every source once
        need = weighed.where("mass > 0").agg(F.max(F.ceil(F.col("tokens") / weight))).first()[0]
        budget = int(need)
        quota = F.greatest(F.floor(weight * budget).cast("long"), F.col("tokens"))
    else:
        quota = F.floor(weight * budget).cast("long")
    weighed = weighed.select("key", "tokens", "n_docs", weight.alias("weight"), quota.alias("quota"))
    return Mixture(exponent, budget, max(least_blocks, -(-budget // block_tokens)), with_epochs(weighed), n_sources)


def with_epochs(sources: DataFrame) -> DataFrame:
    has = F.col("tokens") > 0
    full = F.when(has, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long")
    return sources.select(
        "*",
        full.alias("full"),
        F.when(has, F.col("quota") - full * F.col("tokens")).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("n_docs") / BUCKET).cast("long").alias("buckets"),
    )


def order_keys(seed: int) -> list[Column]:
    """Where a document stands in the permutation of an epoch: bucket first, then a hash, then its id."""
    epoch_hash = F.xxhash64("doc_id", "epoch", F.lit(seed))
    return [
        F.pmod(epoch_hash, F.col("buckets")).alias("bucket"),
        F.xxhash64(epoch_hash, F.lit(seed)).alias("place"),
    ]


def of_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join rows with the table of their sources, of which one may hold most rows."""
    if n_sources <= MOST_SOURCES:
        return rows.join(F.broadcast(sources), "key")
    return salted_join(rows, sources, ["key"], F.col("doc_id"))


def placements(rows: DataFrame, mixture: Mixture, seed: int = SEED) -> DataFrame:
    """Every use of a document: epoch, block, and position in the block."""
    sources = mixture.sources.select("key", "tokens", "quota", "full", "rest", "buckets")
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    uses = of_source(rows, sources, mixture.n_sources).where(last >= 0)
    uses = uses.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    uses = uses.select("*", *order_keys(seed))
    group = ["key", "epoch", "bucket"]
    run = F.floor(F.col("bucket") / RUN).alias("run")
    sums = uses.groupBy(*group).agg(F.sum("n_tokens").alias("n")).select("*", run)
    runs = sums.groupBy("key", "epoch", "run").agg(F.sum("n").alias("n"))
    so_far = [Window.unboundedPreceding, -1]
    of_runs = Window.partitionBy("key", "epoch").orderBy("run").rowsBetween(*so_far)
    runs = runs.select("key", "epoch", "run", F.coalesce(F.sum("n").over(of_runs), F.lit(0)).alias("earlier"))
    in_run = Window.partitionBy("key", "epoch", "run").orderBy("bucket").rowsBetween(*so_far)
    sums = sums.withColumn("n", F.coalesce(F.sum("n").over(in_run), F.lit(0))).join(runs, ["key", "epoch", "run"])
    before = sums.select(*group, (F.col("n") + F.col("earlier")).alias("before"))
    inside = Window.partitionBy(*group).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    uses = uses.withColumn("inside", F.sum("n_tokens").over(inside)).join(before, group)
    uses = uses.withColumn("to", F.col("before") + F.col("inside"))
    uses = uses.where((F.col("epoch") < F.col("full")) | (F.col("to") <= F.col("rest")))
    at = F.col("epoch") * F.col("tokens") + F.col("to") - F.col("n_tokens")
    anywhere = F.pmod("place", F.lit(1 << 20)) / F.lit(1 << 20)
    share = F.when(F.col("quota") > 0, at / F.col("quota")).otherwise(anywhere)
    block = F.least(F.floor(share * mixture.n_blocks), F.lit(mixture.n_blocks - 1)).cast("long")
    uses = uses.withColumn("block", block)
    inside_block = Window.partitionBy("block").orderBy("place", "doc_id", "epoch", "key", "n_tokens")
    return uses.withColumn("position", F.row_number().over(inside_block).cast("long"))


def mix(docs: DataFrame, seed: int = SEED, **limits) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, position) of every use of a document in the mixture."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(measured(docs), "tokens")
    used = placements(rows, planned(rows, scratch, **limits), seed)
    return used.select("doc_id", "source", "n_tokens", "epoch", "block", "position")


def mixed(docs: DataFrame, seed: int = SEED, **limits) -> DataFrame:
    """The rows of `docs`, each as often as the mixture uses it.

    Texts don't move (while the table of sources is small): where a source's last epoch
    ends is one point of its permutation, and each row compares its own place with that.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(measured(docs), "tokens")
    mixture = planned(rows, scratch, **limits)
    used = placements(rows, mixture, seed).where("epoch = full")
    ends = used.groupBy("key").agg(F.max(F.struct("bucket", "place", F.coalesce("doc_id", F.lit(-1)))).alias("end"))
    sources = mixture.sources.join(ends, "key", "left").select("key", "full", "buckets", "end")
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    row = row.select("row", F.col("row.doc_id").alias("doc_id"), source_key(F.col("row.source")).alias("key"))
    row = of_source(row, sources, mixture.n_sources).withColumn("epoch", F.col("full")).select("*", *order_keys(seed))
    again = F.struct("bucket", "place", F.coalesce("doc_id", F.lit(-1))) <= F.col("end")
    copies = F.col("full") + F.when(F.coalesce(again, F.lit(False)), 1).otherwise(0)
    row = row.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return row.select(*[F.col(f"row.`{c}`") for c in names])
