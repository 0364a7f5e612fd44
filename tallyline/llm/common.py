"""What several operators share: kept tables, word rules, bounded samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.materialise import ensure_checkpoint_dir

# Words of the contracts: runs of anything but ASCII white space.
SPACES = "[ \t-\r]+"


class Scratch:
    """Tables kept in the cluster's shared folder, in place of lineage.

    A lost executor costs a re-read. `drop` removes a table that a later one
    replaces; the tables a result still reads stay with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, int] = {}

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        number = self.paths[step] = self.paths.get(step, -1) + 1
        path = f"{self.root}/{step}-{number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, step: str, number: int) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{step}-{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# Rows and bytes that a Python worker gets at once. Texts are long: the usual ten
# thousand rows would be hundreds of MB in a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Python workers get small batches."""
    for name, value in BATCH.items():
        df.sparkSession.conf.set(name, value)
    return df


def give_back() -> None:
    """Hand memory that a Python worker no longer uses back to the system.

    Workers outlive their tasks; what one stage has freed is not to count against
    the executor in the next.
    """
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def least_hashed(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """A fixed sample: the `k` rows of least hash.

    A cut at a hash first leaves some 4 k rows of a large table: their order is
    settled in one task, which is not to read k rows of every partition.
    """
    order = hash_order(*columns)
    share = min(1.0, 4 * k / max(1, df.count()))
    if share < 1:
        df = df.where(order <= F.lit(-(1 << 63) + int(share * (1 << 64))))
    return df.orderBy(order, *columns).limit(k)


def hash_order(*columns: Column | str) -> Column:
    """A fixed pseudo-random order of rows, the same in every run."""
    return F.xxhash64(*columns)
