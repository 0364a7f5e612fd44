"""Periods per tenant: the same as one analysis per tenant, and bounds that reach the scan."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import DATA, Book

from tallyline.functions import periods as per
from tallyline.functions.periods import Period, Periods
from tallyline.operators import anomalies, reconcile, report
from tallyline.operators.ledger import Ledger
from tallyline.plans.analyze import analyze
from tallyline.plans.catalog import Inputs
from tallyline.sources.billing import read_table

SCHEMA = "tenant_id string, project_id string, period_start string, period_end string, reference_date string"
A = ("2024-01-10T00:00:00Z", "2024-01-10T00:10:00Z", "2024-02-01T00:00:00Z")
B = ("2024-01-10T00:05:00Z", "2024-01-12T00:00:00Z", "2024-03-01T00:00:00Z")


def story(tenant):
    """Events before, in and after both periods."""
    book = Book(tenant)
    book.add("subscription_created", 0, "s1", amount_cents=5000, plan_id="p")
    book.add("subscription_created", 400, "s2", amount_cents=7000, customer_id="c2")
    book.add("subscription_updated", 700, "s2", amount_cents=9000, customer_id="c2")
    book.add("payment_failed", 500, "s2", customer_id="c2")
    book.add("payment_failed", 800, "s1")
    book.add("invoice_paid", 30, "s1", amount_cents=4000, invoice_id="i1")
    book.add("invoice_paid", 900, "s1", amount_cents=5000, invoice_id="i2")
    book.add("invoice_refunded", 1000, "s1", amount_cents=900000, invoice_id="i2")
    book.add("subscription_cancelled", 1200, "s1")
    book.add("payment_succeeded", 1300, "s1", amount_cents=1, invoice_id="i3")
    return book


def table(spark, rows):
    return spark.createDataFrame([(t, "p1", *x) for t, x in rows], SCHEMA)


def rows_of(df):
    return Counter(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_one_analysis_per_tenant(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(per, "MOST_TENANTS", 0)
    events = story("t1").df(spark).unionByName(story("t2").df(spark)).unionByName(story("t3").df(spark))
    own = {"t1": A, "t2": B}
    both = analyze(events, Periods(table(spark, own.items())))
    alone = [analyze(events.where(f"tenant_id = '{t}'"), a, b, r) for t, (a, b, r) in own.items()]
    for name in ("discrepancies", "missing_payments", "anomalies", "recon_summary", "ranked_findings", "recommendations", "summary"):
        expected = sum((rows_of(getattr(x, name)) for x in alone), Counter())
        assert rows_of(getattr(both, name)) == expected, name
        assert sum(expected.values())
    for name in ("subscriptions", "customers", "totals"):
        expected = sum((rows_of(getattr(x.ledger, name)) for x in alone), Counter())
        got = getattr(both.ledger, name)
        assert rows_of(got) == expected, name
    lines = rows_of(both.lines("trace"))
    assert lines == sum((rows_of(x.lines("trace")) for x in alone), Counter())


def test_hashes_follow_the_period(spark):
    events = story("t1").df(spark)
    hashes = set()
    for a, b, r in (A, B):
        for period in (Period(a, b, r), Periods(table(spark, [("t1", (a, b, r))]))):
            book = Ledger(events, period)
            found = reconcile.discrepancies(book.subscriptions, book.customers)
            one = reconcile.report_hashes(book.totals, found, period).first()
            hashes.add((one.report_id, one.report_hash, reconcile.document_hashes(book.totals, found, period).first().document_hash))
    assert len(hashes) == 2


def test_missing_ends_come_from_events(spark):
    events = story("t1").df(spark).unionByName(story("t2").df(spark))
    given = table(spark, [("t1", (None, A[1], None)), ("t2", (B[0], None, None)), ("t9", (None, None, None))])
    got = {r.tenant_id: tuple(r)[2:] for r in report.analysis_periods(given, events).table.collect()}
    assert got["t1"] == ("2024-01-10T00:00:00.000000Z", A[1], A[1])
    assert got["t2"] == (B[0], "2024-01-10T00:21:40.000000Z", "2024-01-10T00:21:40.000000Z")
    assert got["t9"] == ("2024-01-01T00:00:00.000Z", "2024-01-31T23:59:59.999Z", "2024-01-31T23:59:59.999Z")


def test_both_ends_belong_to_the_period(spark):
    events = Book().add("payment_failed", 0).add("payment_failed", 600).add("payment_failed", 600.001).df(spark)
    assert Periods(table(spark, [("t1", A)])).within(events).count() == 2


def test_odd_rows(spark):
    """No row, a turned period, a repeated row, half a row, an empty table."""
    events = story("t1").df(spark).unionByName(story("t2").df(spark))
    turned = Periods(table(spark, [("t1", (A[1], A[0], None)), ("t2", (A[0], None, None)), ("t2", (None, A[1], None))]))
    assert turned.n == 1 and turned.within(events).count() == 0
    twice = Periods(table(spark, [("t1", B), ("t1", A), ("t1", A)]))
    assert twice.table.collect()[0].period_start == min(A[0], B[0]) and twice.n == 1
    none = Periods(table(spark, []))
    result = analyze(events, none)
    assert result.findings.count() == result.summary.count() == result.anomalies.count() == 0


def test_without_reference_date_the_end_counts(spark):
    events = story("t1").df(spark)
    found = analyze(events, Periods(table(spark, [("t1", (*A[:2], None))]).drop("reference_date"))).anomalies
    assert {str(r.detected_at) for r in found.collect()} == {"2024-01-10 00:10:00"}


def test_detectors_take_a_date_per_tenant(spark):
    events = story("t1").df(spark).unionByName(story("t2").df(spark))
    dates = Periods(table(spark, [("t1", A), ("t2", B)]))
    got = {(r.tenant_id, str(r.detected_at)) for r in anomalies.out_of_sequence(events, dates).collect()}
    assert got == {("t1", "2024-02-01 00:00:00"), ("t2", "2024-03-01 00:00:00")}


def test_bounds_reach_the_scan(spark, tmp_path):
    """The earliest start and the latest end are filters of the scan; the events are not shuffled for the join."""
    i = Inputs(spark, DATA)
    path = str(tmp_path / "events")
    i.billing.write.parquet(path)
    events = read_table(spark, path, "parquet", i.billing.schema)
    own = Periods(spark.createDataFrame([("tenant-0", "project-main", *A), ("tenant-1", "project-main", *B)], SCHEMA))
    plan = own.within(events)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "timestamp" in line]
    assert any("GreaterThanOrEqual(timestamp,2024-01-10" in line and "LessThanOrEqual(times" in line for line in pushed), plan
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert own.within(events).count() == events.where(
        "(tenant_id = 'tenant-0' and timestamp between '2024-01-10T00:00:00Z' and '2024-01-10T00:10:00Z') or "
        "(tenant_id = 'tenant-1' and timestamp between '2024-01-10T00:05:00Z' and '2024-01-12T00:00:00Z')"
    ).count()

