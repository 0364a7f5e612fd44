"""Nested input documents: churn inputs and a ledger from outside."""

from __future__ import annotations

import json

from conftest import END, START

from tallyline import ChurnInputs, Ledger, Thresholds, analyze
from tallyline.operators import churn
from tallyline.sources import billing as files

REF = "2024-03-10T12:00:00Z"
WHERE = {"tenant_id": "nordwind", "project_id": "web"}


def subscription(name, customer, plan, cents, status="active", month="02"):
    return {
        "subscription_id": name, "customer_id": customer, "plan_id": plan, "status": status, "mrr_cents": cents,
        "current_period_start": f"2024-{month}-11T08:30:00Z", "currency": "EUR", "created_at": "2023-11-11T08:30:00Z",
    }


# bakery pays too little and fails often, harbor uses and books less, museum has nothing left
CUSTOMERS = {
    "bakery": {
        "customer_id": "bakery", "subscriptions": [subscription("b-1", "bakery", "oven", 12_000)], "total_mrr_cents": 12_000,
        "total_paid_cents": 3_500, "payment_failure_count_30d": 4, "last_payment_at": "2024-02-11T12:00:00Z",
    },
    "harbor": {
        "customer_id": "harbor", "total_mrr_cents": 2_500, "total_paid_cents": 2_500,
        "subscriptions": [
            subscription("h-1", "harbor", "pier", 2_500), subscription("h-2", "harbor", "crane", 700, "canceled", "01"),
        ],
    },
    "museum": {"customer_id": "museum", "subscriptions": [], "total_paid_cents": 610},
}
DOCUMENT = WHERE | {
    "reference_date": REF,
    "ledger": WHERE | {
        "customers": {name: WHERE | c for name, c in CUSTOMERS.items()},
        "total_mrr_cents": 14_500, "total_customers": 3, "active_subscriptions": 2, "event_count": 71,
    },
    "usage_metrics": [
        {"customer_id": "harbor", "metric_name": "exports", "current_value": 10, "previous_value": 40, "period_days": 14},
        {"customer_id": "bakery", "metric_name": "logins", "current_value": 18, "previous_value": 12, "period_days": 14},
    ],
    "support_tickets": [
        {"ticket_id": "q-1", "customer_id": "bakery", "created_at": "2024-02-02T07:15:00Z", "severity": "critical", "status": "resolved"},
        {"ticket_id": "q-2", "customer_id": "bakery", "created_at": "2024-03-05T16:40:00Z", "severity": "low", "status": "open"},
    ],
    "plan_downgrades": [{"customer_id": "harbor", "from_plan": "quay", "to_plan": "pier", "changed_at": "2024-03-01T00:00:00Z"}],
}


def tables(spark, tmp_path):
    (tmp_path / "inputs.json").write_text(json.dumps(DOCUMENT, indent=1))
    return files.churn_tables(files.read_churn_inputs(spark, str(tmp_path)))


def test_totals_of_a_tenant_with_two_documents(spark, tmp_path):
    second = DOCUMENT["ledger"] | {"customers": {"mill": WHERE | {"customer_id": "mill", "total_paid_cents": 90}}, "total_customers": 1}
    for n, ledger in enumerate([DOCUMENT["ledger"], second]):
        (tmp_path / f"{n}.json").write_text(json.dumps(ledger))
    rows = files.flatten_totals(files.read_ledger(spark, str(tmp_path))).collect()
    assert [(r.total_customers, r.total_paid_cents, r.total_mrr_cents) for r in rows] == [(4, 6_700, 29_000)]


def test_churn_from_a_document(spark, tmp_path):
    t = tables(spark, tmp_path)
    dates = t["dates"]  # the document's own
    features = churn.churn_features(
        t["customers"], t["usage_metrics"], t["support_tickets"], t["plan_downgrades"], Thresholds(), dates,
        dates.withColumnRenamed("reference_date", "as_of"),
    )
    rows = {r.customer_id: r for r in churn.churn_risks(features).collect()}
    assert {r.calculated_at for r in rows.values()} == {REF}
    # bakery: failures 24, tickets 20 * 2 * sqrt(2), two signals; harbor: usage 18.75, downgrade 22.5, no payment 10, three
    assert {k: (r.risk_score, r.risk_level) for k, r in rows.items()} == {
        "bakery": (89, "critical"),
        "harbor": (62, "high"),
        "museum": (0, "low"),
    }
    signals = {k: [s.signal_type for s in r.contributing_signals] for k, r in rows.items()}
    assert signals == {
        "bakery": ["support_tickets", "payment_failures"],
        "harbor": ["plan_downgrade", "usage_drop", "no_recent_login"],
        "museum": [],
    }


def test_analysis_of_a_given_ledger(spark, tmp_path, book):
    t = tables(spark, tmp_path)
    nothing = book.add("dispute_won", 0).df(spark).limit(0)
    ledger = Ledger.of_tables(nothing, t["subscriptions"], t["customers"], t["totals"], START, END)
    inputs = ChurnInputs(t["customers"], t["usage_metrics"], t["support_tickets"], t["plan_downgrades"], t["dates"])
    result = analyze(nothing, START, END, ledger=ledger, churn_inputs=inputs)
    # canceled subscriptions are not owed
    assert [(r.subscription_id, r.difference_cents) for r in result.discrepancies.collect()] == [("b-1", 8_500)]
    kinds = sorted((r.anomaly_type, r.customer_id) for r in result.anomalies.collect())
    assert kinds == [("missing_invoice", "bakery"), ("missing_invoice", "harbor"), ("payment_failure_spike", "bakery")]
    summary = result.summary.collect()[0]
    assert (summary.ledger_mrr_cents, summary.ledger_customer_count, summary.churn_risk_count) == (14_500, 3, 3)
    assert result.missing_payments.count() == 0
