"""Joins on keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join where null keys are equal to each other; the columns of `left`, then the others of `right`."""
    named = {k: f"right_{k}" for k in keys}
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(r)) for k, r in named.items()])
    joined = left.join(right.withColumnsRenamed(named), same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())
