"""Ledger: the state of every subscription and customer, rebuilt from events.

Every `subscription_created` opens a new generation of its subscription id.
Later updates and cancellations belong to the newest generation. With the
generation number on each row the state is an ordinary aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import ORDER_FIELDS, SCOPE, event_order, present
from tallyline.functions.materialise import store
from tallyline.functions.ordered import ordered_scan
from tallyline.functions.periods import Period, Periods, period_of
from tallyline.functions.skew import HeavyKeys

SUBSCRIPTION = [*SCOPE, "subscription_id"]
CUSTOMER = [*SCOPE, "customer_id"]


def period_events(events: DataFrame, start: str | Period | Periods, end: str | None = None) -> DataFrame:
    """Events of the period, or of their tenants' periods, both ends included."""
    return period_of(start, end).within(events)


def narrow_events(events: DataFrame, start: str | Period | Periods, end: str | None = None) -> DataFrame:
    """The period's subscription events, with the columns the ledger needs of them."""
    rows = period_events(events, start, end).where(
        F.col("event_type").isin(fixed.SUBSCRIPTION_TYPES) & present("subscription_id")
    )
    return rows.select(
        *SUBSCRIPTION,
        *ORDER_FIELDS,
        "event_type",
        "customer_id",
        "amount_cents",
        "currency",
        "plan_id",
        "period_start",
        "period_end",
    )


def subscription_events(
    events: DataFrame, start: str | Period | Periods, end: str | None = None, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Subscription events of the period with their generation number.

    Generation 0 holds updates and cancellations that precede any creation;
    they change nothing.
    """
    narrow = narrow_events(events, start, end)
    created = F.col("event_type") == "subscription_created"
    heavy = heavy or HeavyKeys(events)
    return ordered_scan(
        narrow, SUBSCRIPTION, ORDER_FIELDS, counts={"generation": created}, heavy=heavy.of(SUBSCRIPTION)
    )


def event_states() -> dict[str, Column]:
    """What one subscription event leaves behind. Of several events the largest value of each counts."""
    created = F.col("event_type") == "subscription_created"
    updated = F.col("event_type") == "subscription_updated"
    cancelled = F.col("event_type") == "subscription_cancelled"
    place = event_order().alias("place")
    time_or = lambda name: F.when(created, F.coalesce(name, "timestamp")).otherwise(F.col(name))
    amount = F.when(created, F.coalesce("amount_cents", F.lit(0))).otherwise(F.col("amount_cents"))
    start, end = time_or("period_start"), time_or("period_end")
    # the value of the last event that sets the field, with its place
    last = lambda value, is_set: F.when(
        (created | updated) & is_set, F.struct(place, value.alias("value"))
    )
    return {
        "owner": F.when(created, F.col("customer_id")),
        "plan_id": last(F.col("plan_id"), present("plan_id")),
        "current_period_start": last(start, start.isNotNull()),
        "current_period_end": last(end, end.isNotNull()),
        "mrr_cents": last(amount, amount.isNotNull()),
        "currency": last(F.col("currency"), present("currency")),
        "created_at": F.when(created, F.col("timestamp")),
        "canceled_at": F.when(cancelled, F.col("timestamp")),
        "touched_at": F.col("timestamp"),
    }


def generation_states(numbered: DataFrame) -> DataFrame:
    """What the events of each generation and customer leave behind, from `subscription_events`.

    Small beside the events, and all the ledger needs of them: subscriptions
    and customers are both rolled up from here.
    """
    return (
        numbered.where(F.col("generation") > 0)
        .groupBy(*SUBSCRIPTION, "generation", "customer_id")
        .agg(*[F.max(value).alias(name) for name, value in event_states().items()])
    )


def ledger_subscriptions(states: DataFrame) -> DataFrame:
    """One row per subscription generation, from `generation_states`."""
    fields = ["plan_id", "current_period_start", "current_period_end", "mrr_cents", "currency"]
    return (
        states.groupBy(*SUBSCRIPTION, "generation")
        .agg(
            F.max("owner").alias("customer_id"),
            *[F.max(c)["value"].alias(c) for c in fields],
            F.max("created_at").alias("created_at"),
            F.max("canceled_at").alias("canceled_at"),
        )
        .select(
            *SUBSCRIPTION,
            "generation",
            "customer_id",
            F.coalesce("plan_id", F.lit("unknown")).alias("plan_id"),
            F.when(F.col("canceled_at").isNull(), "active").otherwise("canceled").alias("status"),
            "current_period_start",
            "current_period_end",
            "mrr_cents",
            F.coalesce("currency", F.lit("USD")).alias("currency"),
            "created_at",
            "canceled_at",
            F.lit(False).alias("cancel_at_period_end"),
        )
    )


def ledger_customers(
    events: DataFrame, states: DataFrame, start: str | Period | Periods, end: str | None = None
) -> DataFrame:
    """One row per customer an event of the period touched, without the MRR roll-up."""
    money = period_events(events, start, end).where(F.col("event_type").isin(fixed.MONEY_TYPES))
    touches = money.select(*CUSTOMER, "timestamp", "event_type", "amount_cents").unionByName(
        states.select(
            *CUSTOMER,
            F.col("touched_at").alias("timestamp"),
            F.lit("subscription").alias("event_type"),
            F.lit(None).cast("bigint").alias("amount_cents"),
        )
    )
    is_type = lambda t: F.col("event_type") == t
    paid_in = lambda t: F.coalesce(F.sum(F.when(is_type(t), F.col("amount_cents"))), F.lit(0))
    return touches.groupBy(*CUSTOMER).agg(
        paid_in("invoice_paid").alias("total_paid_cents"),
        paid_in("invoice_refunded").alias("total_refunded_cents"),
        paid_in("invoice_disputed").alias("total_disputed_cents"),
        F.max(F.when(is_type("invoice_paid"), F.col("timestamp"))).alias("last_invoice_at"),
        F.max(F.when(is_type("payment_succeeded"), F.col("timestamp"))).alias("last_payment_at"),
        F.count_if(is_type("payment_failed")).alias("payment_failure_count_30d"),
        F.max("timestamp").alias("updated_at"),
    )


def with_customer_mrr(customers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Add MRR and subscription counts; only active generations count towards MRR."""
    active = F.col("status") == "active"
    per_customer = subscriptions.groupBy(*CUSTOMER).agg(
        F.coalesce(F.sum(F.when(active, F.col("mrr_cents"))), F.lit(0)).alias("total_mrr_cents"),
        F.count_if(active).alias("active_subscriptions"),
        F.count(F.lit(1)).alias("subscription_count"),
    )
    added = ["total_mrr_cents", "active_subscriptions", "subscription_count"]
    return customers.join(per_customer, CUSTOMER, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in added}
    )


def ledger_totals(events: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per tenant and project; `event_count` counts every event given."""
    return totals_of(events.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("event_count")), customers)


def totals_of(counted: DataFrame, customers: DataFrame) -> DataFrame:
    """Ledger totals from the tenants' `event_count` and the customers."""
    summed = customers.groupBy(*SCOPE).agg(
        F.sum("total_mrr_cents").alias("total_mrr_cents"),
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("active_subscriptions").alias("active_subscriptions"),
        F.sum("total_paid_cents").alias("total_paid_cents"),
    )
    numbers = ["total_mrr_cents", "total_customers", "active_subscriptions", "total_paid_cents"]
    return counted.join(summed, SCOPE, "left").select(
        *SCOPE,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers],
        "event_count",
        F.lit(fixed.CONTRACT_VERSION).alias("version"),
    )


def paid_totals(events: DataFrame, start: str | Period | Periods, end: str | None = None) -> DataFrame:
    """What every tenant was paid in the period, as `ledger_totals` has it, from one sum over the events."""
    paid = period_events(events, start, end).where(F.col("event_type") == "invoice_paid")
    return paid.groupBy(*SCOPE).agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total_paid_cents"))


class Ledger:
    """The three ledger tables of one event set and period, or of a period per tenant.

    The generation states are written to the checkpoint folder once; the tables
    read them from there. With `stored` the tables themselves are written too,
    for pipelines that read them many times.
    """

    def __init__(
        self,
        events: DataFrame,
        start: str | Period | Periods,
        end: str | None = None,
        heavy: HeavyKeys | None = None,
        stored: bool = False,
    ):
        self.events, self.period = events, period_of(start, end)
        self.heavy = heavy or HeavyKeys(events)
        keep = store if stored else (lambda df: df)
        states = store(generation_states(subscription_events(events, self.period, heavy=self.heavy)))
        self.subscriptions = keep(ledger_subscriptions(states))
        self.customers = keep(
            with_customer_mrr(ledger_customers(events, states, self.period), self.subscriptions)
        )
        self.totals = keep(ledger_totals(events, self.customers))

    @classmethod
    def of_tables(
        cls,
        events: DataFrame,
        subscriptions: DataFrame,
        customers: DataFrame,
        totals: DataFrame,
        start: str | Period | Periods,
        end: str | None = None,
    ) -> Ledger:
        """A ledger somebody else computed, for example read from ledger documents."""
        book = cls.__new__(cls)
        book.events, book.period = events, period_of(start, end)
        book.heavy = HeavyKeys(events)
        book.subscriptions, book.customers, book.totals = subscriptions, customers, totals
        return book
