"""Exact nearest-rank percentiles of groups of any size.

Equal values are counted before they move, and the value at a rank is selected in two
steps: which bucket of values holds it, from the buckets' counts, then which value of
that bucket. No group's values meet in one task: a window holds the buckets of a group
or the values of a bucket, `BUCKET` at most for values below its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16
BUCKET = 1 << BUCKET_BITS


def nearest_rank(rows: DataFrame, group: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """The group's columns and, for each name, the least value that `percents` of the group's values don't exceed.

    Values are whole numbers; nulls don't count. Percents are from 1 to 100. Groups without a value are left out.
    """
    known = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("bigint").alias("value"))
    counts = known.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("bucket", F.shiftright("value", BUCKET_BITS))
    so_far = [Window.unboundedPreceding, 0]
    of_group = Window.partitionBy(*group)
    buckets = counts.groupBy(*group, "bucket").agg(F.sum("n").alias("n")).withColumns(
        {"upto": F.sum("n").over(of_group.orderBy("bucket").rowsBetween(*so_far)), "total": F.sum("n").over(of_group)}
    )
    wanted = [
        F.struct(F.lit(name).alias("name"), F.expr(f"(total * {percent} + 99) div 100").alias("rank"))
        for name, percent in percents.items()
    ]
    hits = buckets.select(*group, "bucket", "n", "upto", F.inline(F.array(*wanted)))
    before = F.col("upto") - F.col("n")
    hits = hits.where(F.col("rank").between(before + 1, F.col("upto")))
    hits = hits.select(*group, "bucket", "name", (F.col("rank") - before).alias("rank"))
    in_bucket = Window.partitionBy(*group, "bucket", "name").orderBy("value").rowsBetween(*so_far)
    found = counts.join(hits, [*group, "bucket"]).withColumn("upto", F.sum("n").over(in_bucket))
    found = found.where(F.col("rank").between(F.col("upto") - F.col("n") + 1, F.col("upto")))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in percents])
