"""Ordered work on keys of any size.

A window over one key runs in one task. That is fine for ordinary keys and
fatal for a key that holds a large share of the table. `ordered_scan` keeps
ordinary keys on the plain window and cuts the heavy ones into slices of their
full order, at the quantiles that a range partitioning finds: each slice is
worked on by itself, and a one-row-per-slice summary carries the running values
from slice to slice. No row is dropped or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.materialise import store

# Rows of heavy keys in a slice, about.
SLICE_ROWS = 1_000_000


def _scan_columns(partition: list[str], order: list[str], counts: dict[str, Column], previous: dict[str, str]):
    in_order = Window.partitionBy(*partition).orderBy(*order)
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    columns = {out: F.sum(flag.cast("bigint")).over(running) for out, flag in counts.items()}
    columns |= {out: F.lag(col).over(in_order) for out, col in previous.items()}
    return columns, F.row_number().over(in_order)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    counts: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Running counts and previous-row values per key, in `order`.

    `counts` maps a new column to a flag: how many flagged rows the key has up
    to and including this one. `previous` maps a new column to a column whose
    value in the key's previous row it takes. Rows of `heavy` keys are cut
    into slices by their rank in `order`, whatever its columns are.
    """
    counts = counts or {}
    previous = previous or {}
    if heavy is None:
        columns, _ = _scan_columns(keys, order, counts, previous)
        return df.withColumns(columns)

    few = F.broadcast(heavy)
    whole, _ = _scan_columns(keys, order, counts, previous)
    ordinary = df.join(few, keys, "left_anti").withColumns(whole)
    rows = df.join(few, keys, "left_semi")
    n_slices = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SLICE_ROWS))
    # written once: another sample would cut elsewhere
    rows = store(rows.repartitionByRange(n_slices, *keys, *order).withColumn("slice", F.spark_partition_id()))
    columns, position = _scan_columns([*keys, "slice"], order, counts, previous)
    scanned = rows.withColumns(columns | {"first_in_slice": position == 1})

    place = F.struct(*[F.col(c) for c in order])
    by_slice = Window.partitionBy(*keys).orderBy("slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "slice")
        .agg(
            F.count(F.lit(1)).alias("slice_rows"),
            *[F.sum(flag.cast("bigint")).alias(f"{out}_total") for out, flag in counts.items()],
            *[F.max_by(F.struct(F.col(col).alias("value")), place).alias(f"{out}_last") for out, col in previous.items()],
        )
        .select(
            *keys,
            "slice",
            *[F.sum(f"{out}_total").over(earlier).alias(f"{out}_before") for out in counts],
            *[F.lag(f"{out}_last").over(by_slice)["value"].alias(f"{out}_before") for out in previous],
        )
    )
    whole = {out: F.col(out) + F.coalesce(F.col(f"{out}_before"), F.lit(0)) for out in counts}
    whole |= {out: F.when(F.col("first_in_slice"), F.col(f"{out}_before")).otherwise(F.col(out)) for out in previous}
    cut = scanned.join(carried, [*keys, "slice"], "left").withColumns(whole).select(*df.columns, *whole)
    return ordinary.select(*df.columns, *whole).unionByName(cut)
