"""Profiles, contract sweeps, runner metrics."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import END, START, T0

from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.thresholds import THRESHOLD_FIELDS, Thresholds
from tallyline.operators import contracts, metrics, profiles
from tallyline.operators.ledger import Ledger


def tenants(spark, *rows, columns="tenant_id string, project_id string, profile_id string"):
    return spark.createDataFrame(list(rows), columns)


def test_profiles_and_fallback(spark):
    df = tenants(spark, ("t1", "p", "settler"), ("t2", "p", "nope"), ("t3", "p", None))
    rows = {r.tenant_id: r for r in profiles.profile_thresholds(df).collect()}
    assert (rows["t1"].refund_spike_threshold_cents, rows["t1"].risk_score_high_threshold) == (25000, 70.0)
    for name in ("t2", "t3"):
        assert [rows[name][f] for f in THRESHOLD_FIELDS] == [getattr(Thresholds(), f) for f in THRESHOLD_FIELDS]
    assert profiles.profile("keys").duplicate_event_window_seconds == 180
    assert profiles.profile("unknown") == Thresholds()
    assert profiles.profiles_df(spark).count() == 6


def test_overrides_win_and_are_checked(spark):
    columns = "tenant_id string, project_id string, profile_id string, o_refund_spike_threshold_cents bigint, o_usage_drop_weight double"
    df = tenants(spark, ("t1", "p", "aias", -5, 1.5), ("t2", "p", "aias", 0, None), columns=columns)
    effective = profiles.effective_profile(df)
    rows = {r.tenant_id: r for r in effective.collect()}
    assert rows["t1"].refund_spike_threshold_cents == -5
    assert (rows["t2"].refund_spike_threshold_cents, rows["t2"].usage_drop_weight) == (0, 0.4)
    broken = [(r.tenant_id, r.violation) for r in profiles.profile_violations(effective).collect()]
    assert broken == [("t1", "refund_spike_threshold_cents: below 0"), ("t1", "usage_drop_weight: outside 0..1")]


def test_single_thresholds(spark):
    assert profiles.threshold(profiles.profile("settler"), "dispute_spike_threshold") == 3
    assert profiles.threshold(profiles.profile("base"), "no_such_field", 9) == 9
    assert profiles.threshold(None, "dispute_spike_threshold") == 0
    row = spark.range(1).select(profiles.exceeds(F.lit(5), F.lit(5)), profiles.exceeds(F.lit(6), F.lit(5))).collect()[0]
    assert tuple(row) == (False, True)


def test_shipped_profiles_are_valid(spark):
    df = tenants(spark, *[("t", "p", name) for name in fixed.PROFILE_CHANGES])
    assert profiles.profile_violations(profiles.effective_profile(df)).count() == 0


def test_negative_ledger_becomes_rows_not_an_error(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=-5).add("invoice_paid", 1, amount_cents=-10)
    ledger = Ledger(book.df(spark), START, END)
    rows = contracts.contract_violations(
        {"ledger_subscriptions": ledger.subscriptions, "ledger_customers": ledger.customers, "ledger_totals": ledger.totals}
    ).collect()
    assert sorted((r.table_name, r.row_key, r.violation) for r in rows) == [
        ("ledger_customers", "c1", "total_mrr_cents: below 0"),
        ("ledger_customers", "c1", "total_paid_cents: below 0"),
        ("ledger_subscriptions", "s1#1", "mrr_cents: below 0"),
        ("ledger_totals", "total", "total_mrr_cents: below 0"),
    ]


@pytest.mark.parametrize("currency, ok", [("USD", True), ("usd", False), ("US", False), ("USD\n", False)])
def test_currency_form(spark, book, currency, ok):
    book.add("subscription_created", 0, "s1", amount_cents=5, currency=currency)
    ledger = Ledger(book.df(spark), START, END)
    assert (contracts.contract_violations({"ledger_subscriptions": ledger.subscriptions}).count() == 0) == ok


RUN = "runner_id string, job_type string, started_at timestamp, succeeded boolean, retries bigint, is_replay boolean, input_records bigint, output_records bigint, latency_ms bigint"


def test_rollup_windows_percentiles_and_flags(spark):
    runs = [
        ("r", fixed.JOB_ANOMALY_SCAN, T0 + timedelta(minutes=n), n % 4 != 0, 1, n == 3, 10, 100, 10 * n) for n in range(1, 21)
    ]
    runs.append(("r", fixed.JOB_ANOMALY_SCAN, T0 + timedelta(days=1), True, 0, False, 1, 1, 7))
    limits = {"unbounded_input": 1, "high_anomaly_volume": 1999, "excessive_retry": 1, "unbounded_line_items": 1}
    day, other = metrics.rollup(spark.createDataFrame(runs, RUN), limits).orderBy("window_start").collect()
    assert (day.success_count, day.failure_count, day.retry_count, day.idempotent_replay_count) == (15, 5, 20, 1)
    assert (day.latency_ms_p50, day.latency_ms_p95) == (100, 190)
    assert day.cost_risk_flags == ["high_anomaly_volume"] and other.cost_risk_flags == []
    assert other.latency_ms_p95 == 7


def test_metric_rules(spark):
    runs = spark.createDataFrame([("r", "j", T0, True, 0, False, 1, 1, 5)], RUN)
    good = metrics.rollup(runs, dict.fromkeys([f for _, f, _ in metrics.RISK_FLAGS], 1))
    assert metrics.metric_violations(good).count() == 0
    bad = good.withColumn("retry_count", F.lit(-1)).withColumn("latency_ms_p95", F.lit(None).cast("bigint"))
    assert [r.violation for r in metrics.metric_violations(bad).collect()] == ["retry_count: below 0", "latency_ms_p95: required"]
    report = metrics.metrics_report(good, "2024-01-01T00:00:00Z").collect()[0]
    assert (report.module_id, report.schema_version, report.success_count) == ("finops", "1.0.0", 1)
