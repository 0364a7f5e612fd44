"""Anomaly detectors over all events and the ledger.

Every detector yields the columns of `ANOMALY_COLUMNS`. `reference` is what the
finding is about: an event, subscription, invoice, customer or 'total'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import (
    SCOPE,
    dollars,
    event_order,
    millis_between,
    percent_text,
    present,
    round_half_up,
)
from tallyline.functions.hashing import anomaly_id, key_hash
from tallyline.functions.ordered import ordered_scan
from tallyline.functions.periods import Period, Periods, detected
from tallyline.functions.skew import HeavyKeys, salted_join, split_join
from tallyline.functions.thresholds import Thresholds, attach

EVENT = [*SCOPE, "event_id"]
SUBSCRIPTION = [*SCOPE, "subscription_id"]
INVOICE = [*SCOPE, "invoice_id"]
SPIKE_TYPES = {"refund_spike": fixed.REFUND_TYPES, "dispute_spike": fixed.DISPUTE_TYPES}
# One date for all tenants, or that of each tenant's period.
ReferenceDate = str | Period | Periods
ANOMALY_COLUMNS = [
    *SCOPE,
    "anomaly_id",
    "anomaly_type",
    "severity",
    "detected_at",
    "reference",
    "customer_id",
    "subscription_id",
    "description",
    "expected_value",
    "observed_value",
    "difference",
    "confidence",
    "recommended_action",
]


def _anomaly(
    df: DataFrame,
    kind: str,
    reference_date: ReferenceDate,
    reference: Column,
    severity: Column | str,
    description: Column,
    confidence: Column | float,
    action: Column | None = None,
    customer: Column | None = None,
    subscription: Column | None = None,
    expected: Column | None = None,
    observed: Column | None = None,
    difference: Column | None = None,
) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    df = detected(df, reference_date, spread_by=reference)
    text = lambda v: F.lit(None).cast("string") if v is None else v
    number = lambda v: F.lit(None).cast("double") if v is None else v.cast("double")
    return df.select(
        *SCOPE,
        anomaly_id(kind, reference).alias("anomaly_id"),
        F.lit(kind).alias("anomaly_type"),
        lit(severity).alias("severity"),
        "detected_at",
        reference.alias("reference"),
        text(customer).alias("customer_id"),
        text(subscription).alias("subscription_id"),
        description.alias("description"),
        number(expected).alias("expected_value"),
        number(observed).alias("observed_value"),
        number(difference).alias("difference"),
        lit(confidence).cast("double").alias("confidence"),
        lit(fixed.ANOMALY_ACTIONS[kind] if action is None else action).alias("recommended_action"),
    )


def duplicate_events(
    events: DataFrame, thresholds: Thresholds | DataFrame, reference_date: ReferenceDate, heavy: HeavyKeys | None = None
) -> DataFrame:
    """First pair of deliveries of one event id closer together than the window.

    Only ids seen twice go past the first aggregation. Of the copies with one
    timestamp the first two are enough: if there are two, they are a pair with
    gap 0, so no later copy can matter. That cut runs before the shuffle.
    """
    narrow = events.select(*EVENT, "timestamp", "ingest_seq", "event_type", "customer_id")
    repeated = narrow.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    heavy_ids = (heavy or HeavyKeys(events)).of(EVENT)
    same_instant = Window.partitionBy(*EVENT, "timestamp").orderBy("ingest_seq")
    copies = (
        split_join(narrow, repeated.select(*EVENT), EVENT, "left_semi", heavy_ids)
        .withColumn("copy", F.row_number().over(same_instant))
        .where(F.col("copy") <= 2)
    )
    placed = ordered_scan(
        copies,
        EVENT,
        ["timestamp", "ingest_seq"],
        counts={"position": F.lit(True)},
        previous={"previous_at": "timestamp"},
        heavy=heavy_ids,
    )
    gap = millis_between(F.col("timestamp"), F.col("previous_at"))
    close = attach(
        placed.where(F.col("previous_at").isNotNull()).withColumn("gap", gap),
        thresholds,
        "duplicate_event_window_seconds",
        spread_by="event_id",
    ).where(F.col("gap") < F.col("duplicate_event_window_seconds") * 1000)
    first = close.groupBy(*EVENT).agg(
        F.min_by(F.struct("position", "gap", "event_type", "customer_id"), "position").alias("hit")
    )
    position = F.col("hit.position")
    return _anomaly(
        first,
        "duplicate_event",
        reference_date,
        reference=F.col("event_id"),
        severity="high",
        description=F.concat(
            F.lit("Duplicate event detected: "),
            "event_id",
            F.lit(" ("),
            "hit.event_type",
            F.lit(") within "),
            round_half_up(F.col("hit.gap") / 1000.0).cast("string"),
            F.lit("s"),
        ),
        confidence=1.0,
        customer=F.col("hit.customer_id"),
        expected=F.lit(1),
        observed=position,
        difference=position - 1,
    )


def missing_invoices(
    events: DataFrame, subscriptions: DataFrame, reference_date: ReferenceDate, heavy: DataFrame | None = None
) -> DataFrame:
    """Active paying subscriptions without any invoice event, at any time."""
    invoiced = (
        events.where(F.col("event_type").isin(fixed.INVOICED_TYPES) & present("subscription_id"))
        .select(*SUBSCRIPTION)
        .distinct()
    )
    paying = subscriptions.where((F.col("status") == "active") & (F.col("mrr_cents") > 0)).select(
        *SUBSCRIPTION, "customer_id", "mrr_cents"
    )
    return _anomaly(
        split_join(paying, invoiced, SUBSCRIPTION, "left_anti", heavy),
        "missing_invoice",
        reference_date,
        reference=F.col("subscription_id"),
        severity="medium",
        description=F.concat(
            F.lit("Active subscription "), "subscription_id", F.lit(" has no invoice events in period")
        ),
        confidence=0.8,
        customer=F.col("customer_id"),
        subscription=F.col("subscription_id"),
        expected=F.col("mrr_cents"),
        observed=F.lit(0),
        difference=F.col("mrr_cents"),
    )


def invoice_payments(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(fixed.PAYMENT_TYPES) & present("invoice_id"))


def double_charges(events: DataFrame, reference_date: ReferenceDate) -> DataFrame:
    """Invoices paid more than once with the first payment's amount.

    Payments are first counted per invoice and amount; the group that holds the
    first payment tells the amount that counts.
    """
    per_amount = (
        invoice_payments(events)
        .groupBy(*INVOICE, "amount_cents")
        .agg(
            F.count(F.lit(1)).alias("payments"),
            F.sum("amount_cents").alias("cents"),
            F.min(F.struct(event_order().alias("place"), F.col("customer_id"))).alias("first"),
        )
    )
    first_amount = F.coalesce("opening.amount_cents", F.lit(0))
    per_invoice = (
        per_amount.groupBy(*INVOICE)
        .agg(
            F.sum("payments").alias("payments"),
            F.coalesce(F.sum("cents"), F.lit(0)).alias("total"),
            F.min_by(F.struct("amount_cents", "payments", "first.customer_id"), "first").alias("opening"),
            F.coalesce(F.sum(F.when(F.col("amount_cents") == 0, F.col("payments"))), F.lit(0)).alias("zero_payments"),
        )
        .withColumn("first_amount", first_amount)
        .withColumn(
            "same",
            F.when(F.col("opening.amount_cents").isNull(), F.col("zero_payments")).otherwise(F.col("opening.payments")),
        )
        .where(F.col("same") > 1)
    )
    return _anomaly(
        per_invoice,
        "double_charge",
        reference_date,
        reference=F.col("invoice_id"),
        severity="critical",
        description=F.concat(
            F.lit("Potential double charge: "),
            F.col("same").cast("string"),
            F.lit(" payments of "),
            F.col("first_amount").cast("string"),
            F.lit(" cents for invoice "),
            "invoice_id",
        ),
        confidence=0.9,
        customer=F.col("opening.customer_id"),
        expected=F.col("first_amount"),
        observed=F.col("total"),
        difference=F.col("total") - F.col("first_amount"),
    )


def _tenant_sums(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Refunds and disputes per tenant beside its revenue, in one pass."""
    sums = []
    for name, types in SPIKE_TYPES.items():
        own = F.col("event_type").isin(types)
        sums.append(F.count_if(own).alias(f"{name}_n"))
        sums.append(F.coalesce(F.sum(F.when(own, F.col("amount_cents"))), F.lit(0)).alias(f"{name}_cents"))
    any_type = [t for types in SPIKE_TYPES.values() for t in types]
    return (
        events.where(F.col("event_type").isin(any_type))
        .groupBy(*SCOPE)
        .agg(*sums)
        .join(totals.select(*SCOPE, F.col("total_paid_cents").alias("revenue")), SCOPE, "left")
        .withColumn("revenue", F.coalesce("revenue", F.lit(0)))
    )


def tenant_spikes(
    events: DataFrame, totals: DataFrame, thresholds: Thresholds | DataFrame, reference_date: str
) -> DataFrame:
    """Refund and dispute spikes of each tenant.

    Refunds: more cents than the limit; critical beyond the given share of
    revenue. Disputes: at least as many as the limit; critical beyond twice it.
    """
    sums = attach(
        _tenant_sums(events, totals),
        thresholds,
        "refund_spike_threshold_cents",
        "refund_spike_threshold_pct",
        "dispute_spike_threshold",
    )
    revenue, limit_pct = F.col("revenue"), F.col("refund_spike_threshold_pct")
    refunded, disputed = F.col("refund_spike_cents"), F.col("dispute_spike_cents")
    n, limit = F.col("dispute_spike_n"), F.col("dispute_spike_threshold")
    pct = F.when(revenue > 0, F.try_divide(refunded, revenue) * 100).otherwise(F.lit(0.0))
    allowed = revenue * limit_pct / 100

    def spike(kind: str, severity: Column, text: list[Column], expected, observed, difference, confidence) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            severity.alias("severity"),
            F.concat(*text).alias("description"),
            expected.cast("double").alias("expected"),
            observed.cast("double").alias("observed"),
            difference.cast("double").alias("difference"),
            confidence.cast("double").alias("confidence"),
            F.lit(fixed.ANOMALY_ACTIONS[kind]).alias("action"),
        )

    refund = spike(
        "refund_spike",
        F.when(pct > limit_pct, "critical").otherwise("high"),
        [
            F.lit("Refund spike detected: $"),
            dollars(refunded),
            F.lit(" in refunds ("),
            percent_text(refunded, revenue),
            F.lit("% of revenue)"),
        ],
        allowed,
        refunded,
        refunded - allowed,
        F.when((limit_pct == 0) & (pct > 0), 1.0).when(
            limit_pct != 0, F.least(F.try_divide(pct, limit_pct), F.lit(1.0))
        ),
    )
    dispute = spike(
        "dispute_spike",
        F.when(n > limit * 2, "critical").otherwise("high"),
        [
            F.lit("Dispute spike: "),
            n.cast("string"),
            F.lit(" disputes ($"),
            dollars(disputed),
            F.lit(", "),
            percent_text(disputed, revenue),
            F.lit("% of revenue)"),
        ],
        limit,
        n,
        n - limit,
        F.when(limit == 0, 1.0).otherwise(F.least(F.try_divide(n, limit * 2), F.lit(1.0))),
    )
    has_refunds = (F.col("refund_spike_n") > 0) & (refunded > F.col("refund_spike_threshold_cents"))
    found = detected(sums, reference_date).select(
        *SCOPE,
        "detected_at",
        F.inline(F.array_compact(F.array(F.when(has_refunds, refund), F.when((n > 0) & (n >= limit), dispute)))),
    )
    kind = F.col("kind")
    return found.select(
        *SCOPE,
        F.concat(
            F.lit("anomaly-"), kind, F.lit("-"), key_hash(kind, F.col("tenant_id"), F.col("project_id"), F.lit("total"))
        ).alias("anomaly_id"),
        kind.alias("anomaly_type"),
        "severity",
        "detected_at",
        F.lit("total").alias("reference"),
        F.lit(None).cast("string").alias("customer_id"),
        F.lit(None).cast("string").alias("subscription_id"),
        "description",
        F.col("expected").alias("expected_value"),
        F.col("observed").alias("observed_value"),
        "difference",
        "confidence",
        F.col("action").alias("recommended_action"),
        # an undefined confidence (limit 0 and no revenue) makes the finding invalid
    ).where(F.col("confidence").between(0, 1))


def refund_spikes(
    events: DataFrame, totals: DataFrame, thresholds: Thresholds | DataFrame, reference_date: str
) -> DataFrame:
    spikes = tenant_spikes(events, totals, thresholds, reference_date)
    return spikes.where(F.col("anomaly_type") == "refund_spike")


def dispute_spikes(
    events: DataFrame, totals: DataFrame, thresholds: Thresholds | DataFrame, reference_date: str
) -> DataFrame:
    spikes = tenant_spikes(events, totals, thresholds, reference_date)
    return spikes.where(F.col("anomaly_type") == "dispute_spike")


def payment_failure_spikes(customers: DataFrame, thresholds: Thresholds | DataFrame, reference_date: ReferenceDate) -> DataFrame:
    """Customers whose failures are at least the given share of attempts (any success counts once)."""
    failures = F.col("payment_failure_count_30d")
    limit = F.col("payment_failure_spike_threshold")
    tried = (
        attach(
            customers.select(*SCOPE, "customer_id", "payment_failure_count_30d", "last_payment_at"),
            thresholds,
            "payment_failure_spike_threshold",
            spread_by="customer_id",
        )
        .withColumn("attempts", failures + F.when(F.col("last_payment_at").isNotNull(), 1).otherwise(0))
        .where(F.col("attempts") > 0)
        .withColumn("rate", failures / F.col("attempts"))
        .where(F.col("rate") >= limit)
    )
    expected = limit * F.col("attempts")
    return _anomaly(
        tried,
        "payment_failure_spike",
        reference_date,
        reference=F.col("customer_id"),
        severity=F.when(F.col("rate") > 0.5, "critical").otherwise("high"),
        description=F.concat(
            F.lit("Payment failure spike: "),
            failures.cast("string"),
            F.lit(" failures in 30 days ("),
            round_half_up(F.col("rate") * 100).cast("string"),
            F.lit("% rate)"),
        ),
        confidence=F.col("rate"),
        customer=F.col("customer_id"),
        expected=expected,
        observed=failures,
        difference=failures - expected,
    )


def out_of_sequence(events: DataFrame, reference_date: ReferenceDate, heavy: DataFrame | None = None) -> DataFrame:
    """Cancellations before any creation, and payments after any cancellation, of one subscription.

    Both only depend on the subscription's first creation and first
    cancellation, so an aggregate and a join replace an ordered pass. A later
    creation does not reset a cancellation.
    """
    rows = events.where(present("subscription_id"))
    place = event_order()
    kind = F.col("event_type")
    first_of = lambda t: F.min(F.when(kind == t, F.col("place")))
    firsts = (
        rows.select(*SUBSCRIPTION, "event_type", place.alias("place"))
        .groupBy(*SUBSCRIPTION)
        .agg(
            F.count(F.lit(1)).alias("n"),
            first_of("subscription_created").alias("first_created"),
            first_of("subscription_cancelled").alias("first_cancelled"),
        )
        .where((F.col("n") >= 2) & F.col("first_cancelled").isNotNull())
        .drop("n")
    )
    touched = rows.where(kind.isin("subscription_cancelled", *fixed.PAYMENT_TYPES)).select(
        *SUBSCRIPTION, "customer_id", "event_type", "event_id", place.alias("place")
    )
    early_cancel = (kind == "subscription_cancelled") & (
        F.col("first_created").isNull() | (F.col("place") < F.col("first_created"))
    )
    late_payment = kind.isin(fixed.PAYMENT_TYPES) & (F.col("place") > F.col("first_cancelled"))
    found = split_join(touched, firsts, SUBSCRIPTION, "inner", heavy).where(early_cancel | late_payment)
    is_cancel = kind == "subscription_cancelled"
    either = lambda x, y: F.when(is_cancel, F.lit(x)).otherwise(F.lit(y))
    return _anomaly(
        found,
        "out_of_sequence",
        reference_date,
        reference=F.col("event_id"),
        severity=either("medium", "low"),
        description=F.concat(
            either(
                "Cancel event before create for subscription ", "Payment event after cancellation for subscription "
            ),
            "subscription_id",
        ),
        confidence=either(0.9, 0.6),
        action=either(
            fixed.ANOMALY_ACTIONS["cancel_before_create"], fixed.ANOMALY_ACTIONS["payment_after_cancel"]
        ),
        customer=F.col("customer_id"),
        subscription=F.col("subscription_id"),
    )


def cancel_before_create(events: DataFrame, reference_date: ReferenceDate, heavy: DataFrame | None = None) -> DataFrame:
    return out_of_sequence(events, reference_date, heavy).where(F.col("severity") == "medium")


def payment_after_cancel(events: DataFrame, reference_date: ReferenceDate, heavy: DataFrame | None = None) -> DataFrame:
    return out_of_sequence(events, reference_date, heavy).where(F.col("severity") == "low")


def detect(
    events: DataFrame,
    subscriptions: DataFrame,
    customers: DataFrame,
    totals: DataFrame,
    thresholds: Thresholds | DataFrame,
    reference_date: ReferenceDate,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """All detectors, one table."""
    heavy = (heavy or HeavyKeys(events)).look_up(SUBSCRIPTION, EVENT)
    heavy_subscriptions = heavy.of(SUBSCRIPTION)
    found = [
        duplicate_events(events, thresholds, reference_date, heavy),
        missing_invoices(events, subscriptions, reference_date, heavy_subscriptions),
        double_charges(events, reference_date),
        tenant_spikes(events, totals, thresholds, reference_date),
        payment_failure_spikes(customers, thresholds, reference_date),
        out_of_sequence(events, reference_date, heavy_subscriptions),
    ]
    return reduce(DataFrame.unionByName, found)


def _counts_by(anomalies: DataFrame, scopes: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    counted = anomalies.groupBy(*SCOPE).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return (
        scopes.select(*SCOPE)
        .join(counted, SCOPE, "left")
        .unpivot(SCOPE, values, name, "anomaly_count")
        .withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
    )


def stats_by_type(anomalies: DataFrame, scopes: DataFrame) -> DataFrame:
    """Findings per tenant and type, zeros included, for every tenant in `scopes`."""
    return _counts_by(anomalies, scopes, "anomaly_type", fixed.ANOMALY_TYPES, "anomaly_type")


def stats_by_severity(anomalies: DataFrame, scopes: DataFrame) -> DataFrame:
    return _counts_by(anomalies, scopes, "severity", fixed.SEVERITIES, "severity")


def affected_events(anomalies: DataFrame, events: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """(anomaly, event) rows: a table instead of lists that grow with the tenant."""
    heavy = (heavy or HeavyKeys(events)).look_up(SUBSCRIPTION, INVOICE)
    of_type = lambda t: anomalies.where(F.col("anomaly_type") == t)
    about = lambda t, key: of_type(t).select(*SCOPE, "anomaly_id", F.col("reference").alias(key)).distinct()
    out = [*SCOPE, "anomaly_id", "event_id"]

    pair = of_type("duplicate_event").select(
        *SCOPE, "anomaly_id", F.explode(F.array("reference", "reference")).alias("event_id")
    )
    single = of_type("out_of_sequence").select(*SCOPE, "anomaly_id", F.col("reference").alias("event_id"))
    of_subscription = split_join(
        events.where(present("subscription_id")).select(*SUBSCRIPTION, "event_id"),
        about("missing_invoice", "subscription_id"),
        SUBSCRIPTION,
        "inner",
        heavy.of(SUBSCRIPTION),
    ).select(*out)
    of_invoice = split_join(
        invoice_payments(events).select(*INVOICE, "event_id"),
        about("double_charge", "invoice_id"),
        INVOICE,
        "inner",
        heavy.of(INVOICE),
    ).select(*out)
    of_tenant = [
        salted_join(
            events.where(F.col("event_type").isin(types)).select(*SCOPE, "event_id"),
            of_type(kind).select(*SCOPE, "anomaly_id"),
            SCOPE,
            F.col("event_id"),
        ).select(*out)
        for kind, types in SPIKE_TYPES.items()
    ]
    return reduce(DataFrame.unionByName, [pair, single, of_subscription, of_invoice, *of_tenant])
