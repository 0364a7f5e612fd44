"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.materialise import ensure_checkpoint_dir


def ranked(df: DataFrame, groups: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Number the rows of each group 1, 2, … in `order`.

    A window over the group would sort a whole tenant in one task. Here the
    table is range-sorted over all tasks and stored; a row's number is its place
    in its chunk plus the rows its group has in earlier chunks. Without groups all
    rows are one.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not groups:
        return ranked(df.withColumn("all_rows", F.lit(0)), ["all_rows"], order, out).drop("all_rows")
    # a checkpoint keeps the sorted chunks and their order, which the row ids below rely on
    stored = df.orderBy(*groups, *order).checkpoint(eager=True)
    chunked = stored.withColumn("place", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("place", 33))
    earlier = Window.partitionBy(*groups).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*groups, "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    number = F.col("place") - F.col("first_place") + F.col("before") + 1
    return chunked.join(offsets, [*groups, "chunk"]).withColumn(out, number).select(*df.columns, out)
