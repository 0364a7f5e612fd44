"""Hashes: ids from keys, canonical JSON, and order-free digests of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed

DIGEST_PARTS = 8
TREE_WIDTH, TREE_LEVELS = 1024, 4


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def key_hash(*parts: Column, length: int = 16) -> Column:
    """First `length` hex digits of the SHA-256 of the parts joined by ':'."""
    return F.substring(sha256_hex(F.concat_ws(":", *parts)), 1, length)


def anomaly_id(kind: str, reference: Column) -> Column:
    return F.concat(
        F.lit(f"anomaly-{kind}-"),
        key_hash(F.lit(kind), F.col("tenant_id"), F.col("project_id"), reference),
    )


def source_hash() -> Column:
    """SHA-256 over the JSON of the eleven identifying fields; absent ones are left out.

    `timestamp` is hashed as its source text, `timestamp_text`.
    """
    fields = [
        F.col("timestamp_text").alias("timestamp") if f == "timestamp" else F.col(f)
        for f in fixed.HASH_FIELDS
    ]
    return sha256_hex(F.to_json(F.struct(*fields)))


def canonical_json(json_text: Column) -> Column:
    """JSON text with object keys sorted and no white space."""
    return F.to_json(F.parse_json(json_text))


def canonical_hash(json_text: Column) -> Column:
    return sha256_hex(canonical_json(json_text))


def _part(hex_text: Column, i: int) -> Column:
    return F.conv(F.substring(hex_text, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")


def digest_sums(hex_text: Column) -> list[Column]:
    """Aggregates that add up SHA-256 values, eight 32-bit parts each.

    The sums are independent of row order and combine map-side, so a whole
    table can be hashed without bringing its rows together.
    """
    return [F.sum(_part(hex_text, i)).alias(f"digest_{i}") for i in range(DIGEST_PARTS)]


def digest_text(count: Column) -> Column:
    """SHA-256 over the row count and the sums of `digest_sums`."""
    sums = [
        F.coalesce(F.col(f"digest_{i}"), F.lit(0)).cast("decimal(38,0)").cast("string")
        for i in range(DIGEST_PARTS)
    ]
    return sha256_hex(F.concat_ws(":", count.cast("string"), *sums))


def tree_hashes(rows: DataFrame, keys: list[str], place: str, leaf: Column) -> DataFrame:
    """(keys, tree_hash): a hash over each group's rows in order, of any size, that no task sees whole.

    `place` numbers a group's rows 0, 1, …; `leaf` is a row's SHA-256. The hashes of
    `TREE_WIDTH` neighbours, one after the other, are hashed to one, `TREE_LEVELS` times
    at every size: room for 10¹² rows. Unlike the order-free digest it tells the order, and
    a block's hash proves its rows without the others.
    """
    level = rows.select(*keys, F.col(place).alias("place"), leaf.alias("hash"))
    for _ in range(TREE_LEVELS):
        block = F.expr(f"place div {TREE_WIDTH}").alias("block")
        entries = F.array_sort(F.collect_list(F.struct("place", "hash")))  # TREE_WIDTH at most
        level = (
            level.groupBy(*keys, block)
            .agg(sha256_hex(F.array_join(F.transform(entries, lambda e: e["hash"]), "")).alias("hash"))
            .withColumnRenamed("block", "place")
        )
    return level.select(*keys, F.col("hash").alias("tree_hash"))


def fold_regex(text: Column, patterns: list[tuple[str, str, str]], needles: dict[str, str]) -> Column:
    """Apply (name, pattern, replacement) entries one after the other.

    `needles` names a lower-case text every match of a pattern contains; texts
    without it skip the regular expression.
    """

    def one(col: Column, entry: tuple[str, str, str]) -> Column:
        _, pattern, replacement = entry
        replaced = F.regexp_replace(col, pattern, replacement.replace("$", r"\$"))
        needle = needles.get(pattern)
        return replaced if needle is None else F.when(F.contains(F.lower(col), F.lit(needle)), replaced).otherwise(col)

    return reduce(one, patterns, text)
