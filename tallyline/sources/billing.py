"""Readers for billing exports and ledger documents, writers for event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.columns import ORDER_FIELDS, SCOPE
from tallyline.sources import json_array

SUBSCRIPTION_SCHEMA = (
    "subscription_id string, customer_id string, plan_id string, status string, "
    "current_period_start string, current_period_end string, mrr_cents bigint, currency string, "
    "created_at string, canceled_at string, cancel_at_period_end boolean"
)
CUSTOMER_SCHEMA = (
    "customer_id string, tenant_id string, project_id string, "
    f"subscriptions array<struct<{SUBSCRIPTION_SCHEMA.replace(' string', ':string').replace(' bigint', ':bigint').replace(' boolean', ':boolean')}>>, "
    "total_mrr_cents bigint, total_paid_cents bigint, total_refunded_cents bigint, total_disputed_cents bigint, "
    "last_invoice_at string, last_payment_at string, payment_failure_count_30d bigint, updated_at string"
)
LEDGER_SCHEMA = (
    "tenant_id string, project_id string, computed_at string, "
    f"customers map<string, struct<{CUSTOMER_SCHEMA}>>, "
    "total_mrr_cents bigint, total_customers bigint, active_subscriptions bigint, event_count bigint, version string"
)

CHURN_INPUT_SCHEMA = (
    f"tenant_id string, project_id string, reference_date string, ledger struct<{LEDGER_SCHEMA}>, "
    "usage_metrics array<struct<customer_id:string, metric_name:string, current_value:double, "
    "previous_value:double, period_days:int, measured_at:string>>, "
    "support_tickets array<struct<ticket_id:string, customer_id:string, created_at:string, severity:string, "
    "status:string, category:string>>, "
    "plan_downgrades array<struct<customer_id:string, from_plan:string, to_plan:string, changed_at:string>>"
)


def with_scope(raw: DataFrame, tenant_id: str, project_id: str) -> DataFrame:
    """Raw rows of one tenant. Without a sequence in the export the text's hash breaks ties in time."""
    sequence = "ingest_seq" if "ingest_seq" in raw.columns else F.xxhash64("raw").alias("ingest_seq")
    error = ["file_error"] if "file_error" in raw.columns else []
    return raw.where(F.trim("raw") != "").select(
        F.lit(tenant_id).alias("tenant_id"), F.lit(project_id).alias("project_id"), sequence, "raw", *error
    )


# Places in a file below this number; files are numbered above it.
FILE_PLACES = 40


def _file_numbers(spark: SparkSession, table: DataFrame) -> tuple[DataFrame, int]:
    """The files of a table in the order of their names, and how many they are: the driver has listed them."""
    paths = sorted(table.inputFiles())
    named = spark.createDataFrame(list(enumerate(paths)), "file_number long, file_path string")
    return named.withColumn("file_path", json_array.one_slash(F.col("file_path"))), len(paths)


def read_raw(spark: SparkSession, path: str, tenant_id: str, project_id: str, layout: str = "lines") -> DataFrame:
    """Raw events: 'lines' is one JSON value per line (splittable), 'array' a JSON array per file.

    `ingest_seq` follows the input: files by name, rows by their place in the file.
    A file that holds no array, or no JSON, becomes one row with a `file_error`,
    which ingest rejects. Both layouts are split into blocks of any file (see `json_array`).
    """
    none = F.lit(None).cast("string").alias("file_error")
    if layout == "lines":
        text = spark.read.text(path)
        files, n_files = _file_numbers(spark, text)
        # a row takes a byte at least, so block start and row number together rise within a file
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = text.select(
            F.col("value").alias("raw"),
            json_array.one_slash(F.col("_metadata.file_path")).alias("file_path"),
            (F.col("_metadata.file_block_start") + row).alias("place"),
            none,
        )
    elif layout == "array":
        files, n_files = _file_numbers(spark, spark.read.text(path))
        found, rejected = json_array.elements(spark, path, files, n_files)
        rows = found.select("raw", "file_path", "place", none).unionByName(
            rejected.select(
                F.concat(F.lit("file "), "file_path").alias("raw"), "file_path", F.lit(0).cast("long").alias("place"), "file_error"
            )
        )
    else:
        raise ValueError(f"unknown layout {layout!r}")
    numbered = json_array.by_file(rows, files, n_files, "place")
    sequence = F.shiftleft("file_number", FILE_PLACES) + F.col("place")
    return with_scope(numbered.select("raw", sequence.alias("ingest_seq"), "file_error"), tenant_id, project_id)


# JSON carries times in full precision; ignored by the other layouts
TIME_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_table(spark: SparkSession, path: str, layout: str = "parquet", schema: str | None = None) -> DataFrame:
    """Any typed table: events, usage metrics, tickets, downgrades, requests, metrics."""
    reader = spark.read.format(layout).options(**TIME_OPTIONS)
    return (reader.schema(schema) if schema else reader).load(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger documents, nested as exported."""
    return spark.read.schema(LEDGER_SCHEMA).option("multiLine", True).json(path)


def ledger_documents(json_text: DataFrame, column: str) -> DataFrame:
    return json_text.select(F.from_json(column, LEDGER_SCHEMA).alias("doc")).select("doc.*")


def flatten_customers(documents: DataFrame) -> DataFrame:
    """One row per customer of the ledger documents."""
    return (
        documents.select(*SCOPE, F.explode("customers").alias("key", "c"))
        .select(
            *SCOPE,
            F.col("key").alias("customer_id"),
            F.coalesce("c.total_mrr_cents", F.lit(0)).alias("total_mrr_cents"),
            F.coalesce("c.total_paid_cents", F.lit(0)).alias("total_paid_cents"),
            F.coalesce("c.total_refunded_cents", F.lit(0)).alias("total_refunded_cents"),
            F.coalesce("c.total_disputed_cents", F.lit(0)).alias("total_disputed_cents"),
            F.to_timestamp("c.last_invoice_at").alias("last_invoice_at"),
            F.to_timestamp("c.last_payment_at").alias("last_payment_at"),
            F.coalesce("c.payment_failure_count_30d", F.lit(0)).alias("payment_failure_count_30d"),
            F.to_timestamp("c.updated_at").alias("updated_at"),
            F.size(F.filter("c.subscriptions", lambda s: s["status"] == "active")).cast("bigint").alias("active_subscriptions"),
            F.size("c.subscriptions").cast("bigint").alias("subscription_count"),
        )
    )


def flatten_subscriptions(documents: DataFrame) -> DataFrame:
    """One row per subscription of the ledger documents, in document order."""
    times = ["current_period_start", "current_period_end", "created_at", "canceled_at"]
    return (
        documents.select(*SCOPE, F.explode("customers").alias("key", "c"))
        .select(*SCOPE, F.posexplode("c.subscriptions").alias("pos", "s"))
        .select(*SCOPE, (F.col("pos") + 1).cast("bigint").alias("generation"), "s.*")
        .withColumns({t: F.to_timestamp(t) for t in times})
        .withColumn("cancel_at_period_end", F.coalesce("cancel_at_period_end", F.lit(False)))
    )


def flatten_totals(documents: DataFrame) -> DataFrame:
    """One row per tenant, summed over its ledger documents; the paid total is that of its customers."""
    paid = flatten_customers(documents).groupBy(*SCOPE).agg(F.sum("total_paid_cents").alias("total_paid_cents"))
    names = ["total_mrr_cents", "total_customers", "active_subscriptions", "event_count"]
    return (
        documents.groupBy(*SCOPE)
        .agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names])
        .join(paid, SCOPE, "left")
        .withColumn("total_paid_cents", F.coalesce("total_paid_cents", F.lit(0)))
    )


def read_churn_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Churn input documents: a ledger, three lists and a reference date."""
    return spark.read.schema(CHURN_INPUT_SCHEMA).option("multiLine", True).json(path)


def _list_rows(documents: DataFrame, name: str, times: list[str]) -> DataFrame:
    rows = documents.select(*SCOPE, F.posexplode(name).alias("seq", "item")).select(*SCOPE, "seq", "item.*")
    return rows.withColumns({t: F.to_timestamp(t) for t in times})


def churn_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of churn input documents; `seq` is the place in the document's list.

    `dates` has each tenant's reference date, the latest of its documents.
    """
    ledger = documents.select("ledger.*")
    return {
        "subscriptions": flatten_subscriptions(ledger),
        "customers": flatten_customers(ledger),
        "totals": flatten_totals(ledger),
        "usage_metrics": _list_rows(documents, "usage_metrics", ["measured_at"]),
        "support_tickets": _list_rows(documents, "support_tickets", ["created_at"]),
        "plan_downgrades": _list_rows(documents, "plan_downgrades", ["changed_at"]),
        "dates": documents.groupBy(*SCOPE).agg(F.max("reference_date").alias("reference_date")),
    }


def write_events(events: DataFrame, path: str, layout: str = "parquet", mode: str = "overwrite") -> None:
    """Events by day, inside a day by tenant: folders don't multiply with the tenants.

    Files hold few tenants each and are sorted, so a reader of one tenant skips the
    others by the files' statistics. Variant columns are written as JSON text. The
    rebalance hint lets adaptive execution split the files of a large tenant and
    merge those of small ones.
    """
    texts = [f.name for f in events.schema.fields if f.dataType.typeName() == "variant"]
    (
        events.withColumns({c: F.to_json(c) for c in texts})
        .withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "event_date", "tenant_id")
        .sortWithinPartitions("event_date", "tenant_id", *ORDER_FIELDS)
        .write.partitionBy("event_date")
        .mode(mode)
        .format(layout)
        .options(**TIME_OPTIONS)
        .save(path)
    )


def write_table(df: DataFrame, path: str, layout: str = "parquet", mode: str = "overwrite") -> None:
    """A result table, its files sorted by tenant."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "variant"]
    df.withColumns({c: F.to_json(c) for c in texts}).hint("rebalance", "tenant_id").sortWithinPartitions("tenant_id").write.mode(
        mode
    ).format(layout).options(**TIME_OPTIONS).save(path)
