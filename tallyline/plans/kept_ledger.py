"""A ledger kept up to date: each load's events are merged into stored states.

Stored are, by subscription, the states of its generations and its narrow events; by
customer the sums of money events; by tenant the number of events. States and sums are
maxima, sums and counts, so those of a load merge with the stored ones, whatever the
order of the loads. One thing doesn't merge: a creation that comes late, amid events of a
generation already summed up, splits that generation. Each generation therefore keeps the
place of its first and its last event in the order of events. Where, after merging, the
last place of a generation is not before the first of the next, that subscription alone
is rebuilt from its stored events.

A load reads the states of the subscriptions and customers it touches, and the stored
events only of subscriptions it splits. All tables change with one manifest
(`sources/versions.py`): a load counts whole or not at all, and a repeated one is skipped.

Cases: an empty load counts as a load; events of subscriptions not created yet are kept
for a creation that may come; events without tenant, subscription or customer are treated
as `Ledger` does. Loads must not share events, and arrival numbers must differ among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.columns import ORDER_FIELDS, SCOPE, event_order
from tallyline.functions.joins import null_safe_join
from tallyline.functions.materialise import store
from tallyline.functions.ordered import ordered_scan
from tallyline.functions.periods import Period, Periods, period_of
from tallyline.functions.skew import HeavyKeys
from tallyline.operators import ledger as ledgers
from tallyline.operators.ledger import CUSTOMER, SUBSCRIPTION
from tallyline.sources.versions import BUCKETS, VersionedTables

GENERATION = [*SUBSCRIPTION, "generation"]
_MONEY_SUMS = ["total_paid_cents", "total_refunded_cents", "total_disputed_cents", "payment_failure_count_30d"]
_MONEY_LAST = ["last_invoice_at", "last_payment_at", "updated_at"]


def _single_states(events: DataFrame) -> DataFrame:
    """Every event as the state it leaves by itself."""
    created = F.col("event_type") == "subscription_created"
    return events.select(
        *SUBSCRIPTION,
        "customer_id",
        *[value.alias(name) for name, value in ledgers.event_states().items()],
        created.alias("opens"),
        F.when(created, event_order()).alias("opened"),
        event_order().alias("last_place"),
        event_order().alias("place"),
    )


def _numbered(states: DataFrame) -> DataFrame:
    """States with the generation their `place` falls into, by the states that open one.

    A stored state stands at the place of its generation's creation, right after it.
    """
    sorted_by = {f"at_{c}": F.col(f"place.{c}") for c in ORDER_FIELDS} | {"follows": ~F.col("opens")}
    rows = states.withColumns(sorted_by)
    return ordered_scan(
        rows, SUBSCRIPTION, list(sorted_by), counts={"generation": F.col("opens")}, heavy=HeavyKeys(rows).of(SUBSCRIPTION)
    )


def _merged(states: DataFrame) -> DataFrame:
    """One state per generation and customer; `opened` tells all of them where the generation begins."""
    names = [*ledgers.event_states(), "opens", "opened", "last_place"]
    summed = states.groupBy(*GENERATION, "customer_id").agg(*[F.max(c).alias(c) for c in names])
    begins = summed.groupBy(*GENERATION).agg(F.max("opened").alias("opened"))
    return null_safe_join(summed.drop("opened"), begins, GENERATION, "left")


def split_subscriptions(states: DataFrame) -> DataFrame:
    """Subscriptions with a generation whose last event is not before the next generation's first."""
    spans = states.groupBy(*GENERATION).agg(F.max("opened").alias("opened"), F.max("last_place").alias("last_place"))
    following = spans.select(*SUBSCRIPTION, (F.col("generation") - 1).alias("generation"), F.col("opened").alias("next"))
    met = null_safe_join(spans, following, GENERATION, "inner")
    return met.where(F.col("last_place") >= F.col("next")).select(*SUBSCRIPTION).distinct()


class KeptLedger:
    """The ledger of one period, or of a period per tenant, in a folder of its own."""

    def __init__(
        self, spark: SparkSession, folder: str, start: str | Period | Periods, end: str | None = None, buckets: int = BUCKETS
    ):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.period = period_of(start, end)
        self.tables = VersionedTables(spark, folder, buckets)

    def load(self, events: DataFrame, name: str) -> bool:
        """Merge new events, late ones too. False if a load of that name was merged before.

        Raises `Conflict` if another load was committed meanwhile: repeat it with a new `KeptLedger`.
        """
        if self.tables.has(name):
            return False
        change = self.tables.change(name)
        new = change.append("events", ledgers.narrow_events(events, self.period), SUBSCRIPTION)
        self._load_states(change, new)
        self._load_money(change, events)
        counted = events.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("event_count"))
        change.append("counts", counted, SCOPE)  # a row per load and tenant, summed when read
        change.commit()
        return True

    def _load_states(self, change, new: DataFrame) -> None:
        single = _single_states(new)
        old = self._stored_states(single)
        touched = new.select(*SUBSCRIPTION).distinct()
        met = null_safe_join(old, touched, SUBSCRIPTION, "left_semi")
        merged = store(_merged(_numbered(single.unionByName(met.drop("generation").withColumn("place", F.col("opened"))))))
        split = store(split_subscriptions(merged))
        if split.isEmpty():
            change.replace("states", merged, SUBSCRIPTION)
            return
        events = self.tables.read("events", new.schema).unionByName(new)
        again = null_safe_join(events, split, SUBSCRIPTION, "left_semi")
        whole = null_safe_join(merged, split, SUBSCRIPTION, "left_anti")
        change.replace("states", whole.unionByName(_merged(_numbered(_single_states(again)))), SUBSCRIPTION)

    def _stored_states(self, single: DataFrame) -> DataFrame:
        schema = _merged(single.withColumn("generation", F.lit(0).cast("bigint"))).schema
        return self.tables.read("states", schema)

    def _load_money(self, change, events: DataFrame) -> None:
        no_states = events.select(*CUSTOMER, F.col("timestamp").alias("touched_at")).where(F.lit(False))
        new = ledgers.ledger_customers(events, no_states, self.period)
        old = self.tables.read("money", new.schema)
        touched = new.select(*CUSTOMER)
        met = null_safe_join(old, touched, CUSTOMER, "left_semi")
        change.replace("money", _summed_money(new.unionByName(met)), CUSTOMER)

    @property
    def _states(self) -> DataFrame:
        return self.tables.read("states").where(F.col("generation") > 0)

    @property
    def subscriptions(self) -> DataFrame:
        return ledgers.ledger_subscriptions(self._states)

    @property
    def customers(self) -> DataFrame:
        touches = self._states.select(
            *CUSTOMER,
            *[F.lit(0).cast("bigint").alias(c) for c in _MONEY_SUMS],
            *[F.lit(None).cast("timestamp").alias(c) for c in _MONEY_LAST[:-1]],
            F.col("touched_at").alias("updated_at"),
        )
        plain = _summed_money(self.tables.read("money").unionByName(touches))
        return ledgers.with_customer_mrr(plain, self.subscriptions)

    @property
    def totals(self) -> DataFrame:
        counted = self.tables.read("counts").groupBy(*SCOPE).agg(F.sum("event_count").alias("event_count"))
        return ledgers.totals_of(counted, self.customers)

    def ledger(self, events: DataFrame) -> ledgers.Ledger:
        """The stored ledger as a `Ledger` over the events of all loads, for the detectors."""
        return ledgers.Ledger.of_tables(events, self.subscriptions, self.customers, self.totals, self.period)


def _summed_money(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CUSTOMER).agg(
        *[F.sum(c).alias(c) for c in _MONEY_SUMS[:3]],
        F.max("last_invoice_at").alias("last_invoice_at"),
        F.max("last_payment_at").alias("last_payment_at"),
        F.sum(_MONEY_SUMS[3]).alias(_MONEY_SUMS[3]),
        F.max("updated_at").alias("updated_at"),
    )
