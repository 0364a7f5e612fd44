"""Reconciliation of expected MRR with what customers paid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.hashing import digest_sums, digest_text, sha256_hex, tree_hashes
from tallyline.functions.periods import Period, Periods, period_of
from tallyline.functions.ranking import ranked
from tallyline.functions.skew import split_join

TOLERANCE_CENTS = 100


def discrepancies(subscriptions: DataFrame, customers: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Subscriptions not canceled whose customer's payments do not cover the MRR.

    `heavy` names customers with very many subscriptions, if there are any.
    """
    owed = subscriptions.where(F.col("status") != "canceled").select(
        *SCOPE, "customer_id", "subscription_id", "generation", F.col("mrr_cents").alias("expected_mrr_cents")
    )
    paid = customers.select(*SCOPE, "customer_id", "total_paid_cents")
    difference = F.col("expected_mrr_cents") - F.col("observed_mrr_cents")
    return (
        split_join(owed, paid, [*SCOPE, "customer_id"], "inner", heavy)
        .withColumn(
            "observed_mrr_cents",
            F.when(F.col("total_paid_cents") > 0, F.least("expected_mrr_cents", "total_paid_cents")).otherwise(
                F.lit(0).cast("bigint")
            ),
        )
        .withColumn("difference_cents", difference)
        .where(F.abs("difference_cents") > TOLERANCE_CENTS)
        .withColumn("reason", F.when(F.col("difference_cents") > 0, "missing_invoice").otherwise("double_charge"))
        .drop("total_paid_cents")
    )


def missing_payments(customers: DataFrame, period_end: str | Period | Periods) -> DataFrame:
    """A synthetic payment event per customer with failures and no successful payment, at the end of the period."""
    period = Period(period_end, period_end) if isinstance(period_end, str) else period_end
    failing = customers.where((F.col("payment_failure_count_30d") > 0) & F.col("last_payment_at").isNull())
    return period.attach(failing, "period_end", spread_by=F.col("customer_id")).select(
        *SCOPE,
        F.concat(F.lit("missing-payment-"), F.col("customer_id")).alias("event_id"),
        F.lit("payment_succeeded").alias("event_type"),
        F.to_timestamp("period_end").alias("timestamp"),
        "customer_id",
        F.lit("Expected payment based on subscription but none found").alias("note"),
        F.col("payment_failure_count_30d").alias("failure_count"),
    )


def recon_summary(
    totals: DataFrame, found: DataFrame, missing: DataFrame, start: str | Period | Periods, end: str | None = None
) -> DataFrame:
    """Totals per tenant; balanced only without any difference or discrepancy."""
    per_tenant = lambda df, name: df.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias(name))
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    return (
        period_of(start, end)
        .attach(totals, "period_start", "period_end")
        .join(per_tenant(found, "discrepancy_count"), SCOPE, "left")
        .join(per_tenant(missing, "missing_event_count"), SCOPE, "left")
        .select(
            *SCOPE,
            _report_id(),
            "period_start",
            "period_end",
            F.col("total_mrr_cents").alias("total_expected_mrr_cents"),
            F.col("total_paid_cents").alias("total_observed_mrr_cents"),
            (F.col("total_mrr_cents") - F.col("total_paid_cents")).alias("total_difference_cents"),
            count("discrepancy_count").alias("discrepancy_count"),
            count("missing_event_count").alias("missing_event_count"),
            (
                (F.col("total_mrr_cents") == F.col("total_paid_cents")) & (count("discrepancy_count") == 0)
            ).alias("is_balanced"),
            F.lit(fixed.CONTRACT_VERSION).alias("version"),
        )
    )


def report_hashes(
    totals: DataFrame, found: DataFrame, start: str | Period | Periods, end: str | None = None
) -> DataFrame:
    """Per tenant a SHA-256 over the period and the order-free digest of its discrepancies.

    The same at every size: hashes of the entries add up before the shuffle, so no
    tenant's entries have to meet. `document_hashes` gives the hash of the ordered list.
    """
    entry = F.struct("subscription_id", "difference_cents", "reason")
    summed = found.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("discrepancy_count"),
        *digest_sums(sha256_hex(F.to_json(entry))),
    )
    n = F.coalesce("discrepancy_count", F.lit(0))
    return (
        period_of(start, end)
        .attach(totals.select(*SCOPE), "period_start", "period_end")
        .join(summed, SCOPE, "left")
        .select(
            *SCOPE,
            _report_id(),
            n.alias("discrepancy_count"),
            sha256_hex(F.concat_ws("|", *SCOPE, "period_start", "period_end", digest_text(n))).alias("report_hash"),
        )
    )


def _report_id() -> Column:
    return F.concat_ws("-", F.lit("recon"), *SCOPE, "period_start", "period_end").alias("report_id")


def report_tree_hashes(
    totals: DataFrame, found: DataFrame, start: str | Period | Periods, end: str | None = None
) -> DataFrame:
    """Export: a hash of each tenant's report with its discrepancies in order, at any size of a tenant."""
    place = ["customer_id", "subscription_id", "generation", "difference_cents", "reason"]
    entry = F.struct("subscription_id", "difference_cents", "reason")
    in_order = ranked(found.select(*SCOPE, *place), SCOPE, place, "nth").withColumn("place", F.col("nth") - 1)
    listed = tree_hashes(in_order, SCOPE, "place", sha256_hex(F.to_json(entry)))
    none = sha256_hex(F.lit(""))
    text = F.concat_ws("|", *SCOPE, "period_start", "period_end", F.coalesce("tree_hash", none))
    return (
        period_of(start, end)
        .attach(totals.select(*SCOPE), "period_start", "period_end")
        .join(listed, SCOPE, "left")
        .select(*SCOPE, _report_id(), sha256_hex(text).alias("report_tree_hash"))
    )


def document_hashes(
    totals: DataFrame, found: DataFrame, start: str | Period | Periods, end: str | None = None
) -> DataFrame:
    """Export: the SHA-256 of each tenant's report as one JSON document with all discrepancies in order.

    A document is one value, so a tenant's discrepancies meet in one group.
    """
    place = F.struct("customer_id", "subscription_id", "generation", "difference_cents", "reason")
    listed = (
        found.groupBy(*SCOPE)
        .agg(F.array_sort(F.collect_list(place)).alias("items"))
        .select(
            *SCOPE,
            F.transform(
                "items",
                lambda i: F.struct(
                    i["subscription_id"].alias("subscription_id"),
                    i["difference_cents"].alias("difference_cents"),
                    i["reason"].alias("reason"),
                ),
            ).alias("items"),
        )
    )
    no_items = F.array().cast("array<struct<subscription_id:string,difference_cents:bigint,reason:string>>")
    document = F.to_json(F.struct(*SCOPE, "period_start", "period_end", F.coalesce("items", no_items).alias("discrepancies")))
    return (
        period_of(start, end)
        .attach(totals.select(*SCOPE), "period_start", "period_end")
        .join(listed, SCOPE, "left")
        .select(*SCOPE, _report_id(), sha256_hex(document).alias("document_hash"))
    )
