"""The operators as queries over whole tables, with production parameters.

The queries derive the columns of their contracts from what the operators
return. `ORACLES` holds DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    collocations,
    cotraining,
    html_wrapper,
    lexical_search,
    licences,
    mixing,
    oracles,
    packing,
    pivot_search,
    quality_rules,
    simhash_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
)
from tallyline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judged(read(spark, folder, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, "base_failed", "kept")


def op2_cotraining_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = cotraining.trained(docs, read(spark, folder, "labels"))
    chances = [F.round(f"quality.{name}", 6).alias(name) for name in ("words", "page", "good")]
    return cotraining.scored(docs, model).select("doc_id", *chances, "quality.kept")


def op3_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenized(read(spark, folder, "documents"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(read(spark, folder, "documents"))
    return found.select("doc_id", "line", "family", F.round("chance", 6).alias("chance"), F.round("overlap", 6).alias("overlap"), "confirmed")


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_dedup.near_duplicates(read(spark, folder, "documents"))
    return groups.select("doc_id", simhash_dedup.hex_of().alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_search.search(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = html_wrapper.main_text(read(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeats(read(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        suffix_dedup.removed().alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_cotraining_classifier": op2_cotraining_classifier,
    "op3_temperature_mixing": op3_temperature_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_licence_scan": op5_licence_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_pivot_search": op8_pivot_search,
    "op9_html_extraction": op9_html_extraction,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}

ORACLES = oracles.ORACLES
