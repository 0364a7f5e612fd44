"""Contract sweeps: boundary checks of the result tables, broken rules as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.rules import (
    Rule,
    at_least,
    between,
    matches,
    not_null,
    one_of,
    scope_rules,
    violations,
)


def _non_empty(name: str) -> Rule:
    return Rule(name, "too short", F.col(name) == "")


def subscription_rules() -> list[Rule]:
    return [
        *scope_rules(),
        _non_empty("subscription_id"),
        _non_empty("customer_id"),
        one_of("status", fixed.SUBSCRIPTION_STATUSES),
        at_least("mrr_cents", 0),
        matches("currency", fixed.CURRENCY_PATTERN),
    ]


def customer_rules() -> list[Rule]:
    sums = ["total_mrr_cents", "total_paid_cents", "total_refunded_cents", "total_disputed_cents"]
    return [
        *scope_rules(),
        _non_empty("customer_id"),
        *[at_least(c, 0) for c in sums],
        at_least("payment_failure_count_30d", 0),
    ]


def totals_rules() -> list[Rule]:
    counts = ["total_mrr_cents", "total_customers", "active_subscriptions", "event_count"]
    return [*scope_rules(), *[at_least(c, 0) for c in counts]]


def discrepancy_rules() -> list[Rule]:
    return [
        *scope_rules(),
        _non_empty("subscription_id"),
        _non_empty("customer_id"),
        one_of("reason", fixed.DISCREPANCY_REASONS),
    ]


def anomaly_rules() -> list[Rule]:
    return [
        *scope_rules(),
        one_of("anomaly_type", fixed.ANOMALY_TYPES),
        one_of("severity", fixed.SEVERITIES),
        not_null("confidence"),
        between("confidence", 0, 1),
    ]


def risk_rules() -> list[Rule]:
    return [
        *scope_rules(),
        _non_empty("customer_id"),
        between("risk_score", 0, 100),
        one_of("risk_level", fixed.SEVERITIES),
    ]


def cost_rules() -> list[Rule]:
    return [
        *scope_rules(),
        one_of("category", fixed.COST_CATEGORIES),
        _non_empty("customer_id"),
        _non_empty("subscription_id"),
    ]


def contract_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Broken rules over any of the result tables, keyed by table name.

    A tenant with rows here is one whose ledger or report would have been
    refused as a whole; the other tenants are not affected.
    """
    known = {
        "ledger_subscriptions": (subscription_rules, F.concat_ws("#", "subscription_id", F.col("generation").cast("string"))),
        "ledger_customers": (customer_rules, F.col("customer_id")),
        "ledger_totals": (totals_rules, F.lit("total")),
        "recon_discrepancies": (discrepancy_rules, F.col("subscription_id")),
        "anomalies": (anomaly_rules, F.col("anomaly_id")),
        "churn_risks": (risk_rules, F.col("risk_id")),
        "cost_line_items": (cost_rules, F.col("event_id")),
    }
    swept = [violations(df, name, known[name][1], known[name][0]()) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, swept)
