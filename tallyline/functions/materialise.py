"""Where rows are kept: results written once, small inputs spread over all cores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows that one task of costly work row by row gets, about.
TASK_ROWS = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder from `spark.checkpoint.dir`; the session has to name one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(folder)


def store(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the checkpoint folder now and read them from there.

    The stored table is columnar, so each reader takes only its columns, and a
    lost executor costs a re-read, not a re-computation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a table read from few splits to all cores, in tasks of `TASK_ROWS` rows at most, about.

    For row-wise work that costs much more than a shuffle (regular expressions,
    JSON). A split may hold any number of rows, as its size in bytes doesn't tell them, so they
    are counted (from the files' footers). A table of enough splits is left as it is. Apply it
    to the scan, before other work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
