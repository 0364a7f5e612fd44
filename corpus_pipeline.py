"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import cotraining, mixing, packing, simhash_dedup, suffix_dedup
from tallyline.llm.common import Scratch, read

# The stages share their Python workers, and so the executors' memory.
REMEMBERED = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return cotraining.kept(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id."""
    return simhash_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings are cut out of the texts; n_chars follows.

    A cut may fall inside a character; what is left of it goes too. Documents stay,
    also those without any text left.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else None
    kept = suffix_dedup.without_repeats(docs, carried=carried, as_text=True)
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema
    rest = F.from_json("carried", schema) if others else F.lit(None)
    rows = kept.select("doc_id", F.col("kept").alias("text"), rest.alias("rest"))
    columns = {
        "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType),
        "text": F.col("text"),
        "n_chars": F.length("text").cast("long"),
    }
    return rows.select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is there at least once; documents of scarce sources come again."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    pieces = packing.tokenized(docs, remembered=REMEMBERED)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

# The classifier, shingles, byte strings and tokens are beyond SQL; tests hold
# the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs
