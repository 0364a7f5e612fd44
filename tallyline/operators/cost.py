"""Cost snapshots: categorised amounts per tenant and period, or a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.hashing import digest_sums, digest_text, sha256_hex, source_hash
from tallyline.functions.skew import salted_join

REQUEST = [*SCOPE, "period_start", "period_end"]


def cost_events(
    events: DataFrame | None, subscriptions: DataFrame | None = None, given: DataFrame | None = None
) -> DataFrame:
    """Per tenant the given events, or one creation per ledger subscription where none were given.

    `given` names the tenants whose events were given, be they none; without it
    these are the tenants in `events`. Canceled subscriptions are included.
    """
    if subscriptions is None:
        return events
    derived = subscriptions.select(
        *SCOPE,
        F.concat(F.lit("derived_"), "subscription_id").alias("event_id"),
        F.lit("subscription_created").alias("event_type"),
        F.col("created_at").alias("timestamp"),
        "customer_id",
        "subscription_id",
        F.lit(None).cast("string").alias("invoice_id"),
        F.col("mrr_cents").alias("amount_cents"),
        "currency",
        "plan_id",
    )
    if events is None:
        return derived
    named = (events if given is None else given).select(*SCOPE).distinct()
    return events.select(*derived.columns).unionByName(derived.join(named, SCOPE, "left_anti"))


def _category() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind.isin("subscription_created", "subscription_updated", "invoice_paid"), "subscription")
        .when(kind.isin(fixed.REFUND_TYPES), "refund")
        .when(kind.isin("invoice_disputed", "dispute_created"), "dispute")
        .when(kind == "usage_recorded", "usage")
        .otherwise("other")
    )


def _description() -> Column:
    kind = F.col("event_type")
    or_text = lambda name, text: F.coalesce(F.col(name), F.lit(text))
    invoice = or_text("invoice_id", "unknown")
    return (
        F.when(
            kind.isin("subscription_created", "subscription_updated"),
            F.concat(
                F.lit("Subscription "), or_text("subscription_id", "undefined"), F.lit(" - "), or_text("plan_id", "unknown")
            ),
        )
        .when(kind == "invoice_paid", F.concat(F.lit("Invoice payment "), invoice))
        .when(
            kind.isin(fixed.REFUND_TYPES),
            F.concat(F.lit("Refund "), invoice, F.lit(" - "), F.col("cents").cast("string"), F.lit(" cents")),
        )
        .when(kind.isin("invoice_disputed", "dispute_created"), F.concat(F.lit("Dispute "), invoice))
        .when(kind == "usage_recorded", F.concat(F.lit("Usage record "), "customer_id"))
        .otherwise(F.concat(F.lit("Event "), kind))
    )


def line_items(events: DataFrame) -> DataFrame:
    """One cost line per event, amounts with their sign, no period filter."""
    return events.withColumn("cents", F.coalesce("amount_cents", F.lit(0))).select(
        *SCOPE,
        "event_id",
        _category().alias("category"),
        "customer_id",
        "subscription_id",
        F.col("cents").alias("amount_cents"),
        _description().alias("description"),
    )


def snapshot_line_items(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Lines of the accepted snapshots, in the snapshot's currency."""
    accepted = snapshots.select(*REQUEST, "currency")
    return salted_join(items, accepted, SCOPE, F.col("event_id"))


def cost_by_category(items: DataFrame) -> DataFrame:
    """Five categories per tenant, zeros included."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("category") == c, F.col("amount_cents"))), F.lit(0)).alias(c)
        for c in fixed.COST_CATEGORIES
    ]
    return items.groupBy(*SCOPE).agg(*sums).unpivot(SCOPE, fixed.COST_CATEGORIES, "category", "amount_cents")


def _cost_by(items: DataFrame, key: str) -> DataFrame:
    return (
        items.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(*SCOPE, key)
        .agg(F.sum("amount_cents").alias("amount_cents"))
    )


def cost_by_customer(items: DataFrame) -> DataFrame:
    return _cost_by(items, "customer_id")


def cost_by_subscription(items: DataFrame) -> DataFrame:
    return _cost_by(items, "subscription_id")


def assess_requests(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Requests (`REQUEST` columns as ISO text, `has_ledger`) with evidence and `refusal` (NULL: accepted)."""
    text_or_null = F.when(F.col("currency") != "", F.col("currency"))
    evidence = events.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min(text_or_null).alias("currency"),
        F.max(text_or_null).alias("other_currency"),
        F.sum(F.coalesce("amount_cents", F.lit(0))).alias("total_cost_cents"),
    )
    n = F.coalesce("event_count", F.lit(0))
    refusal = (
        F.when((n == 0) & ~F.col("has_ledger"), fixed.REFUSE_NO_DATA)
        .when(n == 0, fixed.REFUSE_NO_EVENTS)
        .when(F.col("currency") != F.col("other_currency"), fixed.REFUSE_CURRENCY)
        .when(F.to_timestamp("period_start") >= F.to_timestamp("period_end"), fixed.REFUSE_PERIOD)
    )
    return requests.join(evidence, SCOPE, "left").withColumn("refusal", refusal).drop("other_currency")


def cost_refusals(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("refusal").isNotNull()).select(*REQUEST, "refusal")


def input_digests(events: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Order-free hash of all events of a tenant.

    A hash over the events as one text would need them in one task; this one
    adds up the row hashes, which combine before the shuffle.
    """
    return (
        events.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("hashed_rows"), *digest_sums(source_hash()))
        .select(*keys, digest_text(F.col("hashed_rows")).alias("input_hash"))
    )


def cache_key() -> Column:
    """SHA-256 over the canonical JSON of scope, period, input hash and capability."""
    return sha256_hex(
        F.to_json(
            F.struct(
                F.lit(fixed.COST_CAPABILITY).alias("capability"),
                "input_hash",
                "period_end",
                "period_start",
                "project_id",
                "tenant_id",
            )
        )
    )


def is_frozen(period_end: Column, as_of: str) -> Column:
    """A period that ended more than 24 hours ago no longer changes."""
    return F.to_timestamp(period_end) < F.to_timestamp(F.lit(as_of)) - F.expr("interval 24 hours")


def cost_snapshots(assessed: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Accepted requests with totals, exact distinct counts, ids and cache key."""
    distinct = events.groupBy(*SCOPE).agg(
        F.count_distinct("customer_id").alias("customer_count"),
        F.count_distinct(F.when(F.col("subscription_id") != "", F.col("subscription_id"))).alias("subscription_count"),
    )
    report_id = F.concat(
        F.lit("cost-snapshot-"),
        F.substring(sha256_hex(F.to_json(F.struct("period_end", "period_start", "project_id", "tenant_id"))), 1, 16),
    )
    return (
        assessed.where(F.col("refusal").isNull())
        .join(distinct, SCOPE)
        .join(input_digests(events), SCOPE)
        .select(
            *REQUEST,
            report_id.alias("report_id"),
            "total_cost_cents",
            F.coalesce("currency", F.lit("USD")).alias("currency"),
            "event_count",
            "customer_count",
            "subscription_count",
            cache_key().alias("cache_key"),
            is_frozen(F.col("period_end"), as_of).alias("cached"),
            F.lit(fixed.CONTRACT_VERSION).alias("version"),
        )
    )


def stale_snapshots(wanted: DataFrame, stored: DataFrame, as_of: str, force: bool = False) -> DataFrame:
    """Wanted snapshots (`REQUEST`, `cache_key`) that must be computed again.

    Frozen periods are skipped when a stored snapshot has the same key.
    """
    if force:
        return wanted
    known = stored.select("cache_key").distinct().withColumn("known", F.lit(True))
    return (
        wanted.join(known, "cache_key", "left")
        .where(F.col("known").isNull() | ~is_frozen(F.col("period_end"), as_of))
        .select(*wanted.columns)
    )
