"""Every operator as a named query over the test tables.

A query takes (spark, folder) and returns a DataFrame over whole tables. Times
are shown as ISO text and lists as joined text, so that results compare as
plain values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline import fixed
from tallyline.functions import columns as c
from tallyline.functions.hashing import canonical_hash, canonical_json, source_hash
from tallyline.functions.materialise import ensure_checkpoint_dir, spread, store
from tallyline.functions.periods import Periods
from tallyline.functions.skew import HeavyKeys
from tallyline.functions.thresholds import Thresholds
from tallyline.operators import (
    anomalies,
    churn,
    contracts,
    cost,
    ingest,
    metrics,
    profiles,
    reconcile,
    redact,
    report,
    requests,
)
from tallyline.operators import ledger as ledgers
from tallyline.plans.analyze import Analysis, ChurnInputs, analyze
from tallyline.plans.kept_ledger import KeptLedger
from tallyline.plans.stored_results import DONE, SNAPSHOTS, finish_requests, store_snapshots
from tallyline.session import configure
from tallyline.sources import billing as files
from tallyline.sources import derived
from tallyline.sources.versions import VersionedTables

START, END = derived.PERIOD_START, derived.PERIOD_END
REFERENCE = derived.REFERENCE_DATE
CHURN_REFERENCE = derived.CHURN_REFERENCE_DATE
# The test events have many failed payments; lower weights spread the scores over all levels.
CHURN_THRESHOLDS = Thresholds(payment_failure_weight=0.1, support_ticket_weight=0.02, plan_downgrade_weight=0.1)
TRACE = "trace-main"
NORMALIZED_AT = "2024-02-20T00:00:00Z"
METRIC_LIMITS = {
    "unbounded_input": 100_000,
    "high_anomaly_volume": 1_000,
    "excessive_retry": 10,
    "unbounded_line_items": 1_000,
}
STORED_BEFORE = "2024-01-20T00:00:00Z"
COST_AS_OF = "2024-01-30T12:00:00Z"
# shift that makes some sums negative, so that the contract sweep has findings
CONTRACT_SHIFT_CENTS = 6000


def shown(df: DataFrame) -> DataFrame:
    """Plain values: times as ISO text, lists joined, variants as JSON text."""

    def one(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.iso_micros(col)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(col, " | ")
        if isinstance(field.dataType, T.VariantType):
            return F.to_json(col)
        return col

    return df.select(*[one(f).alias(f.name) for f in df.schema.fields])


class Inputs:
    """The derived tables of one folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        return derived.read_table(self.spark, self.folder, name)

    @cached_property
    def events(self) -> DataFrame:
        """`events` is read whole and given to all cores: the derivation below is costly per row."""
        return spread(self.table("events"))

    @cached_property
    def billing(self) -> DataFrame:
        return derived.billing_view(self.events)

    @cached_property
    def event_table(self) -> DataFrame:
        """The billing events as ingest leaves them: a written table, for queries that scan it many times."""
        return store(self.billing)

    @cached_property
    def heavy(self) -> HeavyKeys:
        return HeavyKeys(self.billing)

    @cached_property
    def event_keys(self) -> HeavyKeys:
        return HeavyKeys(self.event_table)

    @cached_property
    def period_billing(self) -> DataFrame:
        """Only rows that can lie in the period; the time range reaches the scan."""
        return derived.billing_view(self.events, START, END)

    @cached_property
    def ledger(self) -> ledgers.Ledger:
        return ledgers.Ledger(self.billing, START, END, self.heavy)

    @cached_property
    def period_ledger(self) -> ledgers.Ledger:
        """The ledger where only rows of the period are needed (not `event_count`)."""
        return ledgers.Ledger(self.period_billing, START, END, HeavyKeys(self.period_billing))

    @cached_property
    def stored_ledger(self) -> ledgers.Ledger:
        """The period ledger with its tables written, for queries that read them more than once."""
        return ledgers.Ledger(self.period_billing, START, END, HeavyKeys(self.period_billing), stored=True)

    def own_folder(self, name: str) -> str:
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    @cached_property
    def kept_ledger(self) -> KeptLedger:
        """All events in three loads, each with events that are earlier than others loaded before."""
        book = KeptLedger(self.spark, self.own_folder("ledger"), START, END, buckets=8)
        number = F.pmod(F.xxhash64("event_id"), F.lit(3))
        for n in range(3):
            book.load(self.event_table.where(number == n), f"load-{n}")
        return book

    @cached_property
    def churn_customers(self) -> DataFrame:
        return self.period_ledger.customers

    @cached_property
    def raw(self) -> DataFrame:
        return derived.raw_billing(self.billing)

    @cached_property
    def checked(self) -> DataFrame:
        return ingest.check(self.raw)

    def churn_features(
        self,
        thresholds: Thresholds | DataFrame,
        reference_date: str | DataFrame = CHURN_REFERENCE,
        as_of: str | DataFrame = CHURN_REFERENCE,
    ) -> DataFrame:
        return churn.churn_features(
            self.churn_customers,
            derived.usage_metrics(self.events),
            derived.support_tickets(self.table("orders")),
            derived.plan_downgrades(self.billing, self.heavy),
            thresholds,
            reference_date,
            as_of,
        )

    @cached_property
    def risks(self) -> DataFrame:
        return churn.churn_risks(self.churn_features(CHURN_THRESHOLDS))

    @cached_property
    def anomalies(self) -> DataFrame:
        events, heavy = self.event_table, self.event_keys.look_up(ledgers.SUBSCRIPTION, ledgers.CUSTOMER, anomalies.EVENT)
        book = ledgers.Ledger(events, START, END, heavy, stored=True)
        return anomalies.detect(
            events, book.subscriptions, book.customers, book.totals, Thresholds(), REFERENCE, heavy
        )

    @cached_property
    def tenants(self) -> DataFrame:
        return derived.customer_tenants(spread(self.table("customer")))

    @cached_property
    def requests(self) -> DataFrame:
        return requests.job_requests(self.tenants)

    @cached_property
    def cost_requests(self) -> DataFrame:
        """Two requests per tenant number, one with its period turned round.

        tenant-3 and tenant-4 have no events, tenant-4 has a ledger.
        """
        numbers = self.events.select((F.col("user_id") % 5).alias("n")).distinct()
        period = lambda a, b: F.struct(F.lit(a).alias("period_start"), F.lit(b).alias("period_end"))
        return numbers.select(
            F.concat(F.lit("tenant-"), F.col("n").cast("string")).alias("tenant_id"),
            F.lit("project-main").alias("project_id"),
            (F.col("n") == 4).alias("has_ledger"),
            F.inline(F.array(period(START, END), period(END, START))),
        )

    @cached_property
    def assessed(self) -> DataFrame:
        return cost.assess_requests(self.cost_requests, self.billing)

    def event_ledger(self, stored: bool = False) -> ledgers.Ledger:
        """The ledger of the written events, whose heavy keys are all found in one pass."""
        heavy = self.event_keys.look_up(ledgers.SUBSCRIPTION, ledgers.CUSTOMER, anomalies.EVENT)
        return ledgers.Ledger(self.event_table, START, END, heavy, stored)

    def churn_inputs(self, book: ledgers.Ledger) -> ChurnInputs:
        """Churn of the ledger's customers, beside an analysis."""
        return ChurnInputs(
            book.customers,
            derived.usage_metrics(self.table("events")),
            derived.support_tickets(self.table("orders")),
            derived.plan_downgrades(self.event_table, self.event_keys),
            CHURN_REFERENCE,
        )

    def analysis(self) -> Analysis:
        """Churn has the period of the report here, and so the same ledger: built and written once."""
        book = self.event_ledger(stored=True)
        inputs = self.churn_inputs(book)
        return analyze(self.event_table, START, END, REFERENCE, churn_inputs=inputs, heavy=self.event_keys, ledger=book)

    @cached_property
    def own_periods(self) -> Periods:
        """A period per tenant: as far as it is given, else from the tenant's events."""
        tenants = self.event_table.select(*c.SCOPE).distinct()
        return report.analysis_periods(derived.given_periods(tenants), self.event_table)

    def analysis_by_period(self, churn: bool = True) -> Analysis:
        inputs = self.churn_inputs(self.event_ledger()) if churn else None
        return analyze(self.event_table, self.own_periods, churn_inputs=inputs, heavy=self.event_keys)


Query = Callable[[Inputs], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def query_named(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        CATALOG[name] = fn
        return fn

    return register


def runnable(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: shown(fn(Inputs(spark, folder)))


# -- sources and sinks ---------------------------------------------------------
@query
def src_billing_events(i: Inputs) -> DataFrame:
    return i.billing.drop("period_start", "period_end", "timestamp_text")


@query
def src_ledger_flatten(i: Inputs) -> DataFrame:
    book = i.period_ledger
    documents = files.ledger_documents(derived.ledger_fragments(book.customers, book.subscriptions), "document")
    return files.flatten_subscriptions(documents).drop("generation", "cancel_at_period_end")


@query
def sink_events_json(i: Inputs) -> DataFrame:
    """Events written as JSON by tenant and day to the shared folder, then read back."""
    ensure_checkpoint_dir(i.spark)
    path = f"{i.spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"
    events = i.billing.drop("period_start", "period_end")
    files.write_events(events, path, "json")
    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields if f.name not in ("tenant_id",)
    )
    back = files.read_table(i.spark, path, "json", f"{schema}, tenant_id string, event_date date")
    return back.select("tenant_id", "event_id", "event_type", "timestamp", "customer_id", "amount_cents", "ingest_seq")


def _read_back(i: Inputs, layout: str, texts: DataFrame) -> DataFrame:
    """Events and errors of raw files, written as text and read with the raw reader."""
    ensure_checkpoint_dir(i.spark)
    path = f"{i.spark.sparkContext.getCheckpointDir()}/raw-{uuid.uuid4().hex}"
    writer = texts.write.partitionBy("file") if "file" in texts.columns else texts.write
    writer.text(path)
    checked = store(ingest.check(files.read_raw(i.spark, path, "tenant-all", "project-all", layout)).drop("payload", "metadata"))
    fields = ["event_id", "event_type", "customer_id", "currency"]
    events = checked.where(F.size("messages") == 0)
    events = events.select(*[F.col(f"s_{n}").alias(n) for n in fields], "amount_cents", F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast("string").alias(n) for n in fields]
    return events.unionByName(ingest.errors_of(checked).select(*none, F.lit(None).cast("long").alias("amount_cents"), "error"))


@query
def src_raw_lines(i: Inputs) -> DataFrame:
    return _read_back(i, "lines", i.raw.select("raw"))


@query
def src_raw_array(i: Inputs) -> DataFrame:
    """Large arrays of up to 50 000 events, beside a cut-off file and one that is an object."""
    n = 1 + i.raw.count() // 50_000
    raw = i.raw.select("raw", "ingest_seq", F.pmod(F.xxhash64("raw"), F.lit(n)).alias("file"))
    before = F.lag("raw").over(Window.partitionBy("file").orderBy("ingest_seq", "raw"))
    items = raw.select("file", "ingest_seq", F.concat(F.when(before.isNull(), "[").otherwise(","), "raw").alias("text"))
    odd = [(n, '[{"event_id":"cut'), (n + 1, '{"event_id":"alone"}'), *[(k, "]") for k in range(n)]]
    odd = i.spark.createDataFrame([(k, (1 << 62), t) for k, t in odd], "file long, ingest_seq long, text string")
    lines = items.unionByName(odd).repartition("file").sortWithinPartitions("file", "ingest_seq")
    return _read_back(i, "array", lines.select("file", "text"))


# -- ingest ----------------------------------------------------------------------
def _plain_events(events: DataFrame) -> DataFrame:
    return events.drop("period_start", "period_end", "metadata", "raw_payload", "normalized_at", "validation_errors")


@query
def ingest_events(i: Inputs) -> DataFrame:
    events = ingest.events_of(i.checked, NORMALIZED_AT)
    return _plain_events(events.withColumn("metadata_json", F.to_json("metadata")))


@query
def ingest_events_lenient(i: Inputs) -> DataFrame:
    events = ingest.events_of(i.checked, NORMALIZED_AT, lenient=True)
    return events.select(
        *c.SCOPE, "event_id", "event_type", "customer_id", "currency", "ingest_seq", "validation_errors"
    )


@query
def ingest_errors(i: Inputs) -> DataFrame:
    return ingest.errors_of(i.checked).drop("raw")


@query
def ingest_errors_sample(i: Inputs) -> DataFrame:
    return ingest.first_errors(ingest.errors_of(i.checked), 20).drop("raw")


@query
def ingest_stats(i: Inputs) -> DataFrame:
    return ingest.ingest_stats(i.checked)


@query
def ingest_stats_by_type(i: Inputs) -> DataFrame:
    return ingest.ingest_stats_by_type(ingest.events_of(i.checked, NORMALIZED_AT))


@query
def event_source_hash(i: Inputs) -> DataFrame:
    return i.billing.select(*c.SCOPE, "event_id", "ingest_seq", source_hash().alias("source_hash"))


@query
def contract_violations(i: Inputs) -> DataFrame:
    shifted = i.billing.withColumn("amount_cents", F.col("amount_cents") - CONTRACT_SHIFT_CENTS)
    book = ledgers.Ledger(shifted, START, END, i.heavy, stored=True)
    return contracts.contract_violations(
        {
            "ledger_subscriptions": book.subscriptions,
            "ledger_customers": book.customers,
            "ledger_totals": book.totals,
            "recon_discrepancies": reconcile.discrepancies(book.subscriptions, book.customers, i.heavy.of(ledgers.CUSTOMER)),
            "churn_risks": i.risks,
            "cost_line_items": cost.line_items(shifted),
        }
    )


# -- ledger ----------------------------------------------------------------------
@query
def ledger_period_events(i: Inputs) -> DataFrame:
    events = ledgers.period_events(i.period_billing, START, END)
    return events.select(*c.SCOPE, "event_id", "event_type", "timestamp", "ingest_seq")


@query
def ledger_subscriptions(i: Inputs) -> DataFrame:
    return i.period_ledger.subscriptions


@query
def ledger_customers(i: Inputs) -> DataFrame:
    return i.period_ledger.customers.drop("total_mrr_cents", "active_subscriptions", "subscription_count")


@query
def ledger_customer_mrr(i: Inputs) -> DataFrame:
    return i.period_ledger.customers.select(
        *ledgers.CUSTOMER, "total_mrr_cents", "active_subscriptions", "subscription_count"
    )


@query
def ledger_totals(i: Inputs) -> DataFrame:
    return i.ledger.totals.drop("version")


@query
def ledger_kept_subscriptions(i: Inputs) -> DataFrame:
    return i.kept_ledger.subscriptions


@query
def ledger_kept_totals(i: Inputs) -> DataFrame:
    return i.kept_ledger.totals.drop("version")


# -- reconciliation ----------------------------------------------------------------
def _discrepancies(book: ledgers.Ledger) -> DataFrame:
    return reconcile.discrepancies(book.subscriptions, book.customers, book.heavy.of(ledgers.CUSTOMER))


@query
def recon_discrepancies(i: Inputs) -> DataFrame:
    return _discrepancies(i.period_ledger)


@query
def recon_missing_events(i: Inputs) -> DataFrame:
    return reconcile.missing_payments(i.period_ledger.customers, END)


@query
def recon_summary(i: Inputs) -> DataFrame:
    book = i.stored_ledger
    missing = reconcile.missing_payments(book.customers, END)
    return reconcile.recon_summary(book.totals, _discrepancies(book), missing, START, END).drop("version")


@query
def recon_report_hash(i: Inputs) -> DataFrame:
    book = i.stored_ledger
    return reconcile.report_hashes(book.totals, _discrepancies(book), START, END)


@query
def recon_tree_hash(i: Inputs) -> DataFrame:
    book = i.stored_ledger
    return reconcile.report_tree_hashes(book.totals, _discrepancies(book), START, END)


# -- anomalies ---------------------------------------------------------------------
@query
def anomaly_duplicate_event(i: Inputs) -> DataFrame:
    return anomalies.duplicate_events(i.billing, Thresholds(), REFERENCE, i.heavy)


@query
def anomaly_missing_invoice(i: Inputs) -> DataFrame:
    heavy = i.heavy.of(anomalies.SUBSCRIPTION)
    return anomalies.missing_invoices(i.billing, i.ledger.subscriptions, REFERENCE, heavy)


@query
def anomaly_double_charge(i: Inputs) -> DataFrame:
    return anomalies.double_charges(i.billing, REFERENCE)


@query
def anomaly_refund_spike(i: Inputs) -> DataFrame:
    return anomalies.refund_spikes(i.billing, ledgers.paid_totals(i.period_billing, START, END), Thresholds(), REFERENCE)


@query
def anomaly_dispute_spike(i: Inputs) -> DataFrame:
    return anomalies.dispute_spikes(i.billing, ledgers.paid_totals(i.period_billing, START, END), Thresholds(), REFERENCE)


@query
def anomaly_payment_failure_spike(i: Inputs) -> DataFrame:
    return anomalies.payment_failure_spikes(i.period_ledger.customers, Thresholds(), REFERENCE)


@query
def anomaly_payment_failure_strict(i: Inputs) -> DataFrame:
    strict = Thresholds(payment_failure_spike_threshold=0.7)
    return anomalies.payment_failure_spikes(i.period_ledger.customers, strict, REFERENCE)


@query
def anomaly_cancel_before_create(i: Inputs) -> DataFrame:
    return anomalies.cancel_before_create(i.billing, REFERENCE, i.heavy.of(anomalies.SUBSCRIPTION))


@query
def anomaly_payment_after_cancel(i: Inputs) -> DataFrame:
    return anomalies.payment_after_cancel(i.billing, REFERENCE, i.heavy.of(anomalies.SUBSCRIPTION))


@query
def anomalies_all(i: Inputs) -> DataFrame:
    return i.anomalies


@query
def anomalies_by_profile(i: Inputs) -> DataFrame:
    """The threshold detectors with a profile per tenant."""
    names = F.create_map(
        F.lit("tenant-0"), F.lit("settler"), F.lit("tenant-1"), F.lit("keys"), F.lit("tenant-2"), F.lit("readylayer")
    )
    book = i.period_ledger
    tenants = book.totals.select(*c.SCOPE, F.try_element_at(names, F.col("tenant_id")).alias("profile_id"))
    own = profiles.profile_thresholds(tenants)
    found = anomalies.duplicate_events(i.billing, own, REFERENCE, i.heavy)
    found = found.unionByName(anomalies.refund_spikes(i.billing, book.totals, own, REFERENCE))
    return found.unionByName(anomalies.payment_failure_spikes(book.customers, own, REFERENCE))


@query
def anomaly_stats_by_type(i: Inputs) -> DataFrame:
    return anomalies.stats_by_type(i.anomalies, i.event_table.select(*c.SCOPE).distinct())


@query
def anomaly_stats_by_severity(i: Inputs) -> DataFrame:
    return anomalies.stats_by_severity(i.anomalies, i.event_table.select(*c.SCOPE).distinct())


@query
def anomaly_events(i: Inputs) -> DataFrame:
    return anomalies.affected_events(store(i.anomalies), i.event_table, i.event_keys)


# -- churn -------------------------------------------------------------------------
@query
def churn_signal_payment(i: Inputs) -> DataFrame:
    return churn.signal(i.churn_features(CHURN_THRESHOLDS), "payment_failures")


@query
def churn_signal_usage(i: Inputs) -> DataFrame:
    return churn.signal(i.churn_features(CHURN_THRESHOLDS), "usage_drop")


@query
def churn_signal_tickets(i: Inputs) -> DataFrame:
    return churn.signal(i.churn_features(CHURN_THRESHOLDS), "support_tickets")


@query
def churn_signal_downgrade(i: Inputs) -> DataFrame:
    return churn.signal(i.churn_features(CHURN_THRESHOLDS), "plan_downgrade")


@query
def churn_signal_inactivity(i: Inputs) -> DataFrame:
    return churn.signal(i.churn_features(CHURN_THRESHOLDS), "no_recent_login")


@query
def churn_risk_score(i: Inputs) -> DataFrame:
    return i.risks.drop("contributing_signals", "explanation", "recommended_actions", "version")


@query
def churn_by_tenant_date(i: Inputs) -> DataFrame:
    """Scores where every tenant has a reference date of its own, some days after its last event."""
    last = i.billing.groupBy(*c.SCOPE).agg(F.max("timestamp").alias("t"))
    days = F.substring("tenant_id", 8, 9).cast("int") * 9 + 21
    dates = last.select(*c.SCOPE, c.iso_micros(F.date_trunc("day", "t") + F.make_dt_interval(days)).alias("reference_date"))
    features = i.churn_features(CHURN_THRESHOLDS, dates, dates.withColumnRenamed("reference_date", "as_of"))
    return churn.churn_risks(features).drop("contributing_signals", "explanation", "recommended_actions", "version")


@query
def churn_explanations(i: Inputs) -> DataFrame:
    return i.risks.select(*c.SCOPE, "customer_id", "explanation")


@query
def churn_recommendations(i: Inputs) -> DataFrame:
    return i.risks.select(*c.SCOPE, "customer_id", "recommended_actions")


@query
def churn_ranked(i: Inputs) -> DataFrame:
    return churn.rank_risks(i.risks.select(*c.SCOPE, "customer_id", "risk_id", "risk_score", "risk_level"))


@query
def churn_stats(i: Inputs) -> DataFrame:
    return churn.churn_stats(i.risks)


# -- cost --------------------------------------------------------------------------
@query
def cost_from_ledger(i: Inputs) -> DataFrame:
    return cost.line_items(cost.cost_events(None, i.period_ledger.subscriptions))


@query
def cost_line_items(i: Inputs) -> DataFrame:
    return cost.snapshot_line_items(cost.line_items(i.billing), i.assessed.where(F.col("refusal").isNull()))


@query
def cost_by_category(i: Inputs) -> DataFrame:
    return cost.cost_by_category(cost.line_items(i.billing))


@query
def cost_by_customer(i: Inputs) -> DataFrame:
    return cost.cost_by_customer(cost.line_items(i.billing))


@query
def cost_by_subscription(i: Inputs) -> DataFrame:
    return cost.cost_by_subscription(cost.line_items(i.billing))


@query
def cost_snapshot(i: Inputs) -> DataFrame:
    return cost.cost_snapshots(i.assessed, i.billing, COST_AS_OF).drop("cache_key", "version")


@query
def cost_refusals(i: Inputs) -> DataFrame:
    return cost.cost_refusals(i.assessed)


@query
def cost_cache_key(i: Inputs) -> DataFrame:
    return cost.cost_snapshots(i.assessed, i.billing, COST_AS_OF).select(*cost.REQUEST, "cache_key")


def _daily(events: DataFrame) -> DataFrame:
    """A wanted snapshot per tenant and day of the events."""
    day = F.date_format("timestamp", "yyyy-MM-dd")
    dated = events.withColumns(
        {
            "period_start": F.concat(day, F.lit("T00:00:00.000Z")),
            "period_end": F.concat(day, F.lit("T23:59:59.999Z")),
        }
    )
    keyed = cost.input_digests(dated, cost.REQUEST)
    return keyed.select(*cost.REQUEST, cost.cache_key().alias("cache_key"))


@query
def cost_incremental(i: Inputs) -> DataFrame:
    """Daily snapshots to compute again, given those an earlier run stored."""

    # the earlier run saw events in arrival order up to its own time
    stored = _daily(i.billing.where(F.col("timestamp") < F.to_timestamp(F.lit(STORED_BEFORE))))
    return cost.stale_snapshots(_daily(i.billing), stored, COST_AS_OF).drop("cache_key")


@query
def cost_stored_snapshots(i: Inputs) -> DataFrame:
    """The daily snapshots after two runs and a repetition of the first, with the run that stored each."""
    folder = i.own_folder("snapshots")
    events = i.event_table
    early = events.where(F.col("timestamp") < F.to_timestamp(F.lit(STORED_BEFORE)))
    for run, seen in (("run-1", early), ("run-2", events), ("run-1", events)):
        store_snapshots(VersionedTables(i.spark, folder, buckets=8), _daily(seen), COST_AS_OF, run)
    return VersionedTables(i.spark, folder, buckets=8).read(SNAPSHOTS).drop("cache_key")


# -- findings and report -----------------------------------------------------------
@query
def report_period(i: Inputs) -> DataFrame:
    return report.report_period(i.cost_requests.select(*c.SCOPE).distinct(), i.billing)


@query
def findings(i: Inputs) -> DataFrame:
    return i.analysis().findings.drop("tie")


@query
def findings_ranked(i: Inputs) -> DataFrame:
    return i.analysis().ranked_findings.select(*c.SCOPE, "finding_id", "severity", "category", "finding_rank")


@query
def findings_by_period(i: Inputs) -> DataFrame:
    """Ranked findings where every tenant has its own period and reference date."""
    return i.analysis_by_period().ranked_findings.drop("evidence", "tie")


@query
def anomalies_by_period(i: Inputs) -> DataFrame:
    return i.analysis_by_period(churn=False).anomalies


@query
def report_summary_by_period(i: Inputs) -> DataFrame:
    return i.analysis_by_period().summary


@query
def recon_summary_by_period(i: Inputs) -> DataFrame:
    return i.analysis_by_period(churn=False).recon_summary.drop("version")


@query
def ledger_subscriptions_by_period(i: Inputs) -> DataFrame:
    book = ledgers.Ledger(i.event_table, i.own_periods, heavy=i.event_keys)
    return book.subscriptions.drop("current_period_start", "current_period_end", "cancel_at_period_end")


@query
def recommendations(i: Inputs) -> DataFrame:
    return i.analysis().recommendations


@query
def report_summary(i: Inputs) -> DataFrame:
    return i.analysis().summary


@query
def report_envelope(i: Inputs) -> DataFrame:
    return i.analysis().envelopes(TRACE)


@query
def report_tree_hash(i: Inputs) -> DataFrame:
    return i.analysis().tree_hashes(TRACE)


@query
def report_markdown_lines(i: Inputs) -> DataFrame:
    return i.analysis().lines(TRACE)


@query_named("canonical_hash")
def canonical_hashes(i: Inputs) -> DataFrame:
    payloads = derived.event_payloads(i.events)
    return payloads.select(
        "event_id",
        canonical_json(F.col("payload")).alias("canonical"),
        canonical_hash(F.col("payload")).alias("canonical_hash"),
    )


# -- work queue --------------------------------------------------------------------
@query
def job_requests(i: Inputs) -> DataFrame:
    return i.requests


@query
def job_standalone_requests(i: Inputs) -> DataFrame:
    return requests.standalone_requests(i.tenants, fixed.STABLE_TIMESTAMP, "tallyline")


@query
def job_bundles(i: Inputs) -> DataFrame:
    return requests.request_bundles(i.requests).select(*c.SCOPE, "trace_id", "job_count", "canonical_hash")


@query
def job_priority_ids(i: Inputs) -> DataFrame:
    return requests.priority_ids(i.anomalies, i.risks)


@query
def job_request_violations(i: Inputs) -> DataFrame:
    return requests.request_violations(*derived.broken_requests(i.requests))


@query
def job_request_dedupe(i: Inputs) -> DataFrame:
    number = F.regexp_extract("tenant_id", r"(\d+)", 1).cast("bigint")
    again = i.requests.where(number % 5 == 0).withColumn("requested_at", F.lit("2024-02-01T00:00:00.000Z"))
    done = i.requests.where(number % 7 == 0)
    kept = requests.dedupe_requests(i.requests.unionByName(again), done)
    return kept.select(*c.SCOPE, "job_type", "job_id", "requested_at", "idempotency_key", "copies")


@query
def job_requests_done(i: Inputs) -> DataFrame:
    """Requests done after two runs whose second is given all of them, and a repetition of the first."""
    folder = i.own_folder("requests")
    number = F.regexp_extract("tenant_id", r"(\d+)", 1).cast("bigint")
    some = i.requests.where(number % 7 == 0)
    for run, given in (("run-1", some), ("run-2", i.requests.unionByName(some)), ("run-1", i.requests)):
        finish_requests(VersionedTables(i.spark, folder, buckets=8), given, run)
    done = VersionedTables(i.spark, folder, buckets=8).read(DONE)
    return done.select(*c.SCOPE, "job_type", "idempotency_key", "copies", "done_by")


# -- profiles ----------------------------------------------------------------------
@query
def profile_thresholds(i: Inputs) -> DataFrame:
    return profiles.profile_thresholds(i.tenants.select(*c.SCOPE, "profile_id"))


@query
def profile_effective(i: Inputs) -> DataFrame:
    return profiles.effective_profile(i.tenants)


@query
def profile_violations(i: Inputs) -> DataFrame:
    return profiles.profile_violations(profiles.effective_profile(i.tenants))


# -- redaction ---------------------------------------------------------------------
def _texts(i: Inputs) -> DataFrame:
    return derived.planted_secrets(spread(i.table("documents")))


@query
def redact_typed(i: Inputs) -> DataFrame:
    return redact.redact_columns(_texts(i), ["text"], "typed")


@query
def redact_inline(i: Inputs) -> DataFrame:
    return redact.redact_columns(_texts(i), ["text"], "inline")


@query
def redact_whole_value(i: Inputs) -> DataFrame:
    return redact.redact_columns(_texts(i), ["text"], "whole")


@query
def redact_pattern_list(i: Inputs) -> DataFrame:
    return redact.redact_columns(_texts(i), ["text"], "list")


@query
def redact_hits(i: Inputs) -> DataFrame:
    return redact.redact_hits(_texts(i), ["doc_id"], "text")


@query
def redact_conversations(i: Inputs) -> DataFrame:
    return redact.redact_columns(spread(i.table("conversations")), ["text"], "list")


@query
def redact_payload_keys(i: Inputs) -> DataFrame:
    payloads = derived.event_payloads(i.events)
    return payloads.withColumn("payload", redact.redact_payloads(F.col("payload")))


@query
def redact_typed_rows(i: Inputs) -> DataFrame:
    """Typed values of every kind by name: maps, structs, lists, free JSON, malformed and clean payloads."""
    rows = redact.redact_row(derived.typed_secrets(i.events))
    texts = [F.to_json(c).alias(c) for c in ("counts", "login", "lists", "free")]
    return rows.select("event_id", *texts, "api_key", redact.redact_payloads(F.col("payload")).alias("payload"))


# -- runner metrics ----------------------------------------------------------------
@query
def runner_metrics_rollup(i: Inputs) -> DataFrame:
    return metrics.rollup(derived.run_log(i.events), METRIC_LIMITS)


@query
def runner_metrics_violations(i: Inputs) -> DataFrame:
    """The roll-up with faults planted by the counts themselves."""
    rolled = metrics.rollup(derived.run_log(i.events), METRIC_LIMITS)
    faulty = rolled.withColumns(
        {
            "retry_count": F.col("retry_count") - 10,
            "latency_ms_p50": F.when(F.col("output_records") % 3 != 0, F.col("latency_ms_p50")),
        }
    )
    return metrics.metric_violations(faulty)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(fn) for name, fn in CATALOG.items()}
