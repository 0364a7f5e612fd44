"""Churn signals, score, level and texts on pinned rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest

from tallyline.functions.thresholds import Thresholds
from tallyline.operators import churn

REF = "2024-02-20T00:00:00Z"
NOW = datetime(2024, 2, 20, tzinfo=timezone.utc)
BASE = Thresholds()


def days_ago(n: float) -> datetime:
    return NOW - timedelta(days=n)


def features(spark, customers, usage=(), tickets=(), downgrades=(), thresholds=BASE):
    """customers: (id, mrr, failures, last payment); usage: (id, name, previous, current); …"""
    scope = "tenant_id string, project_id string, customer_id string"
    cust = spark.createDataFrame(
        [("t1", "p1", c, m, 1, f, p) for c, m, f, p in customers],
        f"{scope}, total_mrr_cents bigint, subscription_count bigint, payment_failure_count_30d bigint, last_payment_at timestamp",
    )
    use = spark.createDataFrame(
        [("t1", "p1", c, n, float(p), float(q), 30, i) for i, (c, n, p, q) in enumerate(usage)],
        f"{scope}, metric_name string, previous_value double, current_value double, period_days int, seq bigint",
    )
    tick = spark.createDataFrame(
        [("t1", "p1", c, sv, st) for c, sv, st in tickets], f"{scope}, severity string, status string"
    )
    down = spark.createDataFrame(
        [("t1", "p1", c, w, i) for i, (c, w) in enumerate(downgrades)], f"{scope}, changed_at timestamp, seq bigint"
    )
    return churn.churn_features(cust, use, tick, down, thresholds, REF, REF)


def weight(spark, name, *args, **kwargs):
    rows = churn.signal(features(spark, *args, **kwargs), name).collect()
    return (rows[0].weight, rows[0].evidence) if rows else None


QUIET = ("c1", 0, 0, NOW)


@pytest.mark.parametrize("failures, expected", [(0, None), (1, 0.06), (5, 0.3), (10, 0.6), (40, 0.6)])
def test_payment_failures(spark, failures, expected):
    found = weight(spark, "payment_failures", [("c1", 0, failures, NOW)])
    assert found is None if expected is None else found[0] == pytest.approx(expected)


def test_payment_failure_cap(spark):
    heavy = Thresholds(payment_failure_weight=0.8)
    assert weight(spark, "payment_failures", [("c1", 0, 10, NOW)], thresholds=heavy)[0] == 0.9


@pytest.mark.parametrize("previous, current, expected", [(100, 70, None), (1000, 699, 0.25 * 0.301), (0, 0, None), (10, 0, 0.25), (10, -5, 0.25)])
def test_usage_drop(spark, previous, current, expected):
    found = weight(spark, "usage_drop", [QUIET], usage=[("c1", "api", previous, current)])
    assert found is None if expected is None else found[0] == pytest.approx(expected)


def test_usage_drop_takes_largest_and_first_on_ties(spark):
    rows = [("c1", "a", 10, 5), ("c1", "b", 100, 20), ("c1", "c", 10, 2)]
    text = weight(spark, "usage_drop", [QUIET], usage=rows)[1]
    assert text[0] == 'Usage metric "b" dropped 80.0%' and text[1] == "From 100.00 to 20.00"


@pytest.mark.parametrize(
    "tickets, expected",
    [
        ([("c1", "low", "open")], 0.2),
        ([("c1", "low", "open")] * 3, 0.2 * 3**0.5),
        ([("c1", "low", "open")] * 4, 0.2 * 1.3 * 2),
        ([("c1", "low", "closed")] * 4, 0.4),
        ([("c1", "high", "closed")], 0.2 * 1.5),
        ([("c1", "critical", "resolved"), ("c1", "high", "open")], 0.2 * 2 * 2**0.5),
        ([("c1", "critical", "open")] * 9, 0.9),
    ],
)
def test_support_tickets(spark, tickets, expected):
    assert weight(spark, "support_tickets", [QUIET], tickets=tickets)[0] == pytest.approx(expected)


@pytest.mark.parametrize("days, recent", [([30], 1), ([30.001], 0), ([-5], 1), ([1, 2, 400], 2), ([1] * 20, 20)])
def test_plan_downgrade(spark, days, recent):
    found = weight(spark, "plan_downgrade", [QUIET], downgrades=[("c1", days_ago(d)) for d in days])
    assert found[0] == pytest.approx(min(0.15 * (1 + 0.5 * recent), 0.8))
    assert (found[1][1] == "Most recent downgrade >30 days ago") == (recent == 0)


@pytest.mark.parametrize("mrr, last, expected", [(0, None, None), (5, None, 0.1), (5, 34.999, None), (5, 35, 0.1 * 35 / 90), (5, 200, 0.1), (-5, 45, 0.05)])
def test_inactivity(spark, mrr, last, expected):
    found = weight(spark, "no_recent_login", [("c1", mrr, 0, None if last is None else days_ago(last))])
    assert found is None if expected is None else found[0] == pytest.approx(expected)


def risk(spark, *args, **kwargs):
    return churn.churn_risks(features(spark, *args, **kwargs)).collect()[0]


def test_no_signal(spark):
    row = risk(spark, [QUIET])
    assert (row.risk_score, row.risk_level, row.recommended_actions, row.signal_count) == (0, "low", [], 0)
    assert row.explanation == "Customer c1 shows no significant churn risk signals."


def test_signals_sorted_by_weight_with_stable_ties(spark):
    even = Thresholds(payment_failure_weight=0.5, support_ticket_weight=0.1)
    row = risk(
        spark, [("c1", 0, 1, NOW)], usage=[("c1", "api", 10, 1)], tickets=[("c1", "low", "open")], thresholds=even
    )
    assert [s.signal_type for s in row.contributing_signals] == ["usage_drop", "payment_failures", "support_tickets"]
    assert row.explanation == (
        "Customer c1 has risk score 51/100 based on: usage drop (23% impact), payment failures (10% impact), "
        "support tickets (10% impact)."
    )
    assert row.recommended_actions[1].startswith("Usage:") and row.recommended_actions[0].startswith("Schedule")


def test_score_is_capped_and_unknown_customers_are_ignored(spark):
    row = risk(
        spark,
        [("c1", 5, 10, None)],
        usage=[("c1", "api", 10, 0), ("ghost", "api", 10, 0)],
        tickets=[("c1", "critical", "open")] * 9 + [("ghost", "low", "open")],
        downgrades=[("c1", days_ago(1))] * 9,
    )
    assert (row.risk_score, row.risk_level, row.signal_count, row.support_tickets_count) == (100, "critical", 5, 9)


@pytest.mark.parametrize("score, level", [(29, "low"), (30, "medium"), (50, "high"), (74, "high"), (75, "critical")])
def test_levels_at_the_limits(spark, score, level):
    # two downgrade-free signals would interact; one signal of weight score/100 is exact
    only = Thresholds(usage_drop_weight=score / 100)
    assert risk(spark, [QUIET], usage=[("c1", "api", 10, 0)], thresholds=only).risk_level == level


def test_ranking_and_stats(spark):
    people = [("b", 0, 1, NOW), ("a", 0, 1, NOW), ("z", 0, 10, NOW), ("q", 0, 0, NOW)]
    risks = churn.churn_risks(features(spark, people))
    ranked = churn.rank_risks(risks).collect()
    assert [(r.customer_id, r.risk_rank) for r in sorted(ranked, key=lambda r: r.risk_rank)] == [
        ("z", 1), ("a", 2), ("b", 3), ("q", 4),
    ]
    stats = churn.churn_stats(risks).collect()[0]
    assert (stats.total_assessed, stats.high_count, stats.low_count) == (4, 1, 3)
    assert stats.average_score == (60 + 6 + 6) / 4


def test_queries_hold_customers_with_many_tickets(spark):
    """Sums over several tickets, and the multiplier of customers with more than three open ones."""
    from tallyline.plans.catalog import CHURN_THRESHOLDS, Inputs

    features = Inputs(spark, "/root/testdata/sf0.01").churn_features(CHURN_THRESHOLDS)
    rows = features.select("support_tickets_count", "open_tickets", "critical_tickets", "high_tickets", "w_support_tickets").collect()
    assert sum(r.support_tickets_count for r in rows) > 1000
    urgent = [r for r in rows if not r.critical_tickets and not r.high_tickets and r.open_tickets > 3]
    assert urgent
    for r in urgent:
        assert r.w_support_tickets == pytest.approx(0.02 * 1.3 * r.support_tickets_count**0.5)
