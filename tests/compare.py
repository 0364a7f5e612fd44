"""Compare a query with its SQL oracle as multisets of plain values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    return value


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con, text: str) -> tuple[list[str], Counter]:
    cursor = con.execute(text)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    rows = Counter(tuple(plain(r[j]) for j in order) for r in cursor.fetchall())
    return [columns[j] for j in order], rows


def difference(df, con, text: str) -> str | None:
    names, ours = rows_of_spark(df)
    other_names, theirs = rows_of_duckdb(con, text)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; {sum(extra.values())} only in Spark, "
        f"{sum(missing.values())} only in the oracle\ncolumns {names}\nSpark  {list(extra)[:2]}\noracle {list(missing)[:2]}"
    )
