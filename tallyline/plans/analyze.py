"""The combined analysis: ledger, reconciliation, anomalies, churn, findings, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.materialise import store
from tallyline.functions.periods import Periods, period_of
from tallyline.functions.skew import HeavyKeys
from tallyline.functions.thresholds import Thresholds
from tallyline.operators import anomalies, churn, profiles, reconcile, report
from tallyline.operators.ledger import CUSTOMER, SUBSCRIPTION, Ledger


@dataclass
class ChurnInputs:
    """Churn has its own ledger, so its period may differ from that of the report."""

    customers: DataFrame
    usage_metrics: DataFrame
    support_tickets: DataFrame
    plan_downgrades: DataFrame
    reference_date: str | DataFrame
    as_of: str | DataFrame | None = None


@dataclass
class Analysis:
    """The tables of one analysis. Combined tables are built when first asked for."""

    ledger: Ledger
    discrepancies: DataFrame
    missing_payments: DataFrame
    anomalies: DataFrame
    risks: DataFrame | None
    requests: DataFrame | None
    raw_counts: DataFrame | None
    keep: Callable[[DataFrame], DataFrame]

    @cached_property
    def recon_summary(self) -> DataFrame:
        book = self.ledger
        return reconcile.recon_summary(
            book.totals, self.discrepancies, self.missing_payments, book.period
        )

    @cached_property
    def findings(self) -> DataFrame:
        return report.findings(self.discrepancies, self.anomalies, self.risks)

    @cached_property
    def ranked_findings(self) -> DataFrame:
        return report.rank_findings(self.findings)

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.keep(report.recommendations(self.anomalies, self.risks))

    @cached_property
    def summary(self) -> DataFrame:
        book = self.ledger
        periods = book.period.attach(book.totals.select(*SCOPE), "period_start", "period_end")
        return self.keep(
            report.report_summary(
                periods, book.totals, self.discrepancies, self.anomalies, self.risks, self.requests, self.raw_counts
            )
        )

    def envelopes(self, trace_id: str) -> DataFrame:
        return report.report_envelopes(self.summary, self.findings, self.recommendations, F.lit(trace_id))

    def documents(self, trace_id: str) -> DataFrame:
        """Export: hashes of the tenants' reports as whole documents."""
        return report.document_hashes(self.summary, self.ranked_findings, self.recommendations, F.lit(trace_id))

    def tree_hashes(self, trace_id: str) -> DataFrame:
        """Export: hashes of the tenants' reports with their findings in order, at any size of a tenant."""
        return report.report_tree_hashes(self.summary, self.ranked_findings, self.recommendations, F.lit(trace_id))

    def lines(self, trace_id: str, title: str = "Billing Report") -> DataFrame:
        envelopes = self.keep(self.envelopes(trace_id))
        return report.report_lines(self.summary, envelopes, self.ranked_findings, self.recommendations, title)


def _as_of(inputs: ChurnInputs) -> str | DataFrame:
    if inputs.as_of is not None:
        return inputs.as_of
    dates = inputs.reference_date
    return dates if isinstance(dates, str) else dates.withColumnRenamed("reference_date", "as_of")


def analyze(
    events: DataFrame,
    start: str | Periods,
    end: str | None = None,
    reference_date: str | None = None,
    thresholds: Thresholds | DataFrame | None = None,
    churn_inputs: ChurnInputs | None = None,
    requests: DataFrame | None = None,
    raw_counts: DataFrame | None = None,
    stored: bool = True,
    heavy: HeavyKeys | None = None,
    ledger: Ledger | None = None,
) -> Analysis:
    """Run everything over `events`; the ledger and the finding tables are written once and shared.

    `start` may be a table of periods (`report.analysis_periods`): every tenant then has its
    own period and reference date, and tenants without one get no results. A `ledger` given
    is used instead of one built from the events.
    """
    keep = store if stored else (lambda df: df)
    period = period_of(start, end)
    events = period.known(events, "event_id")
    reference_date = reference_date or (end if isinstance(start, str) else period)
    thresholds = thresholds or profiles.profile(fixed.DEFAULT_REPORT_PROFILE)
    heavy = (heavy or HeavyKeys(events)).look_up(SUBSCRIPTION, CUSTOMER, anomalies.EVENT)
    ledger = ledger or Ledger(events, period, heavy=heavy, stored=stored)
    found = keep(reconcile.discrepancies(ledger.subscriptions, ledger.customers, heavy.of(CUSTOMER)))
    anomaly_table = keep(
        anomalies.detect(
            events, ledger.subscriptions, ledger.customers, ledger.totals, thresholds, reference_date, heavy
        )
    )
    risks = None
    if churn_inputs is not None:
        features = churn.churn_features(
            period.known(churn_inputs.customers, "customer_id"),
            churn_inputs.usage_metrics,
            churn_inputs.support_tickets,
            churn_inputs.plan_downgrades,
            thresholds,
            churn_inputs.reference_date,
            _as_of(churn_inputs),
        )
        risks = keep(churn.churn_risks(features))
    return Analysis(
        ledger=ledger,
        discrepancies=found,
        missing_payments=reconcile.missing_payments(ledger.customers, period),
        anomalies=anomaly_table,
        risks=risks,
        requests=requests,
        raw_counts=raw_counts,
        keep=keep,
    )
