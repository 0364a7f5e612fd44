"""Anomaly detectors: thresholds at equality, ties, and every documented oddity."""

from __future__ import annotations

from conftest import END, REF, START, Book

from pyspark.sql import functions as F

from tallyline.functions.thresholds import Thresholds
from tallyline.operators import anomalies as a
from tallyline.operators.ledger import Ledger

BASE = Thresholds()


def duplicates(spark, book, thresholds=BASE):
    rows = a.duplicate_events(book.df(spark), thresholds, REF).collect()
    return {r.reference: (r.observed_value, r.difference, r.description) for r in rows}


def test_duplicate_gap_must_be_below_window(spark, book):
    book.add("invoice_paid", 0, event_id="x").add("invoice_paid", 300, event_id="x")
    assert duplicates(spark, book) == {}
    book.add("invoice_paid", 599.999, event_id="x")
    assert duplicates(spark, book) == {"x": (3.0, 2.0, "Duplicate event detected: x (invoice_paid) within 300s")}


def test_duplicate_reports_first_close_pair_once(spark, book):
    for second in (0, 1000, 1010, 1020, 5000):
        book.add("invoice_paid", second, event_id="x")
    assert duplicates(spark, book)["x"][:2] == (3.0, 2.0)


def test_exact_copies_with_one_timestamp(spark, book):
    for n in range(6):
        book.add("invoice_paid", 0, event_id="x", customer_id=f"c{n}")
    row = a.duplicate_events(book.df(spark), BASE, REF).collect()[0]
    assert (row.observed_value, row.customer_id) == (2.0, "c1")


def test_duplicate_window_zero_finds_nothing(spark, book):
    book.add("invoice_paid", 0, event_id="x").add("invoice_paid", 0, event_id="x")
    assert duplicates(spark, book, Thresholds(duplicate_event_window_seconds=0)) == {}


def test_duplicate_gap_uses_whole_milliseconds(spark, book):
    book.add("invoice_paid", 0.0009, event_id="x").add("invoice_paid", 300.0001, event_id="x")
    assert duplicates(spark, book) == {}


def missing(spark, book):
    ledger = Ledger(book.df(spark), START, END)
    rows = a.missing_invoices(book.df(spark), ledger.subscriptions, REF).collect()
    return sorted((r.subscription_id, r.expected_value) for r in rows)


def test_missing_invoice_per_generation_unless_any_invoice_event(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100).add("subscription_created", 1, "s1", amount_cents=200)
    book.add("subscription_created", 0, "s2", amount_cents=0)
    book.add("subscription_created", 0, "s3", amount_cents=5).add("subscription_cancelled", 1, "s3")
    book.add("subscription_created", 0, "s4", amount_cents=5).add("invoice_failed", -9_000_000, "s4")
    book.add("subscription_created", 0, "s5", amount_cents=5).add("payment_succeeded", 1, "s5")
    assert missing(spark, book) == [("s1", 100.0), ("s1", 200.0), ("s5", 5.0)]


def charges(spark, book):
    rows = a.double_charges(book.df(spark), REF).collect()
    return {r.reference: (r.expected_value, r.observed_value, r.difference, r.customer_id) for r in rows}


def test_paid_and_succeeded_with_one_amount_is_a_double_charge(spark, book):
    book.add("payment_succeeded", 1, invoice_id="i1", amount_cents=70, customer_id="later")
    book.add("invoice_paid", 0, invoice_id="i1", amount_cents=70, customer_id="first")
    assert charges(spark, book) == {"i1": (70.0, 140.0, 70.0, "first")}


def test_only_the_first_amount_counts(spark, book):
    book.add("invoice_paid", 0, invoice_id="i1", amount_cents=1)
    book.add("invoice_paid", 1, invoice_id="i1", amount_cents=2).add("invoice_paid", 2, invoice_id="i1", amount_cents=2)
    assert charges(spark, book) == {}


def test_missing_first_amount_reads_as_zero_but_never_equals_it(spark, book):
    book.add("invoice_paid", 0, invoice_id="i1").add("invoice_paid", 1, invoice_id="i1")
    book.add("invoice_paid", 0, invoice_id="i2").add("invoice_paid", 1, invoice_id="i2", amount_cents=0)
    book.add("invoice_paid", 2, invoice_id="i2", amount_cents=0).add("invoice_paid", 3, invoice_id="i2", amount_cents=9)
    assert charges(spark, book) == {"i2": (0.0, 9.0, 9.0, "c1")}


def test_single_or_blank_invoices_are_ignored(spark, book):
    book.add("invoice_paid", 0, invoice_id="i1", amount_cents=1)
    for second in (0, 1):
        book.add("invoice_paid", second, invoice_id="", amount_cents=5)
        book.add("invoice_paid", second, invoice_id=None, amount_cents=5)
    assert charges(spark, book) == {}


def spikes(spark, book, detector, thresholds=BASE):
    ledger = Ledger(book.df(spark), START, END)
    rows = detector(book.df(spark), ledger.totals, thresholds, REF).collect()
    return [(r.severity, r.expected_value, r.observed_value, r.confidence, r.description) for r in rows]


def test_refund_spike_strictly_above_limit(spark, book):
    book.add("invoice_paid", 0, amount_cents=400_000).add("refund_issued", 1, amount_cents=100_000)
    assert spikes(spark, book, a.refund_spikes) == []
    book.add("invoice_refunded", 2, amount_cents=1)
    text = "Refund spike detected: $1000.01 in refunds (25.0% of revenue)"
    assert spikes(spark, book, a.refund_spikes) == [("critical", 40_000.0, 100_001.0, 1.0, text)]


def test_refund_spike_without_revenue_has_confidence_zero(spark, book):
    book.add("refund_issued", 1, amount_cents=200_000)
    assert [s[:4] for s in spikes(spark, book, a.refund_spikes)] == [("high", 0.0, 200_000.0, 0.0)]


def test_undefined_confidence_drops_the_finding(spark, book):
    book.add("refund_issued", 1, amount_cents=200_000)
    assert spikes(spark, book, a.refund_spikes, Thresholds(refund_spike_threshold_pct=0.0)) == []
    book.add("invoice_paid", 1, amount_cents=100)
    zero = Thresholds(refund_spike_threshold_pct=0.0)
    assert [s[0:4:3] for s in spikes(spark, book, a.refund_spikes, zero)] == [("critical", 1.0)]


def test_dispute_spike_levels(spark, book):
    for n in range(4):
        book.add("dispute_created", n, amount_cents=10)
    book.add("dispute_won", 9)
    assert spikes(spark, book, a.dispute_spikes) == []
    book.add("dispute_lost", 5, amount_cents=10)
    assert [s[:4] for s in spikes(spark, book, a.dispute_spikes)] == [("high", 5.0, 5.0, 0.5)]
    for n in range(5):
        book.add("invoice_disputed", n, amount_cents=10)
    assert spikes(spark, book, a.dispute_spikes)[0][0] == "high"
    book.add("invoice_disputed", 20, amount_cents=10)
    assert [s[:4] for s in spikes(spark, book, a.dispute_spikes)] == [("critical", 5.0, 11.0, 1.0)]


def test_payment_failure_rate_at_equality(spark, book):
    book.add("payment_failed", 0).add("payment_succeeded", 1)
    customers = Ledger(book.df(spark), START, END).customers
    row = a.payment_failure_spikes(customers, Thresholds(payment_failure_spike_threshold=0.5), REF).collect()[0]
    assert (row.severity, row.confidence, row.expected_value, row.difference) == ("high", 0.5, 1.0, 0.0)
    assert "(50% rate)" in row.description
    assert a.payment_failure_spikes(customers, Thresholds(payment_failure_spike_threshold=0.51), REF).count() == 0


def sequence(spark, book):
    df = book.df(spark)
    before = a.cancel_before_create(df, REF).collect()
    after = a.payment_after_cancel(df, REF).collect()
    return sorted(r.reference for r in before), sorted(r.reference for r in after)


def test_cancel_before_create_needs_two_events(spark, book):
    book.add("subscription_cancelled", 0, "s1")
    assert sequence(spark, book) == ([], [])
    book.add("subscription_created", 1, "s1")
    assert sequence(spark, book) == (["e000"], [])


def test_every_cancel_before_the_first_create(spark, book):
    book.add("subscription_cancelled", 0, "s1").add("subscription_cancelled", 1, "s1")
    book.add("subscription_created", 2, "s1").add("subscription_cancelled", 3, "s1")
    assert sequence(spark, book) == (["e000", "e001"], [])


def test_payment_after_cancel_is_not_reset_by_a_new_creation(spark, book):
    book.add("subscription_created", 0, "s1").add("invoice_paid", 1, "s1").add("subscription_cancelled", 2, "s1")
    book.add("subscription_created", 3, "s1").add("invoice_paid", 4, "s1").add("payment_succeeded", 5, "s1")
    book.add("payment_failed", 6, "s1")
    assert sequence(spark, book) == ([], ["e004", "e005"])


def test_ties_in_time_follow_event_id(spark, book):
    book.add("subscription_cancelled", 0, "s1", event_id="b").add("subscription_created", 0, "s1", event_id="a")
    book.add("invoice_paid", 0, "s1", event_id="c")
    assert sequence(spark, book) == ([], ["c"])


def test_ledger_only_scan(spark, book):
    """With no events at all only detectors on the ledger can fire."""
    book.add("subscription_created", 0, "s1", amount_cents=100).add("invoice_paid", 1, "s1", amount_cents=100)
    book.add("payment_failed", 2)
    ledger = Ledger(book.df(spark), START, END)
    nothing = book.df(spark).limit(0)
    rows = a.detect(nothing, ledger.subscriptions, ledger.customers, ledger.totals, BASE, REF).collect()
    assert sorted(r.anomaly_type for r in rows) == ["missing_invoice", "payment_failure_spike"]


def test_detectors_side_by_side(spark, book):
    """A bill paid twice under two event ids, a customer whose cards fail, and a refund too small to matter."""
    book.add("subscription_created", 3, "loom", amount_cents=1_750, customer_id="atelier")
    book.add("invoice_paid", 90, "loom", invoice_id="R-77", amount_cents=1_750, customer_id="atelier")
    book.add("invoice_paid", 4_000, "loom", invoice_id="R-77", amount_cents=1_750, customer_id="atelier")
    for second in (7, 800, 90_000):
        book.add("payment_failed", second, customer_id="kiosk")
    book.add("invoice_refunded", 95_000, "loom", invoice_id="R-60", amount_cents=120, customer_id="atelier")
    df = book.df(spark)
    ledger = Ledger(df, START, END)
    rows = a.detect(df, ledger.subscriptions, ledger.customers, ledger.totals, BASE, REF).collect()
    assert sorted((r.anomaly_type, r.reference) for r in rows) == [
        ("double_charge", "R-77"),
        ("payment_failure_spike", "kiosk"),
    ]


def test_stats_include_zeros(spark, book):
    book.add("payment_failed", 0)
    df = book.df(spark)
    ledger = Ledger(df, START, END)
    found = a.detect(df, ledger.subscriptions, ledger.customers, ledger.totals, BASE, REF)
    by_type = {r.anomaly_type: r.anomaly_count for r in a.stats_by_type(found, ledger.totals).collect()}
    assert len(by_type) == 9 and by_type["payment_failure_spike"] == 1 and by_type["usage_drop"] == 0
    by_severity = {r.severity: r.anomaly_count for r in a.stats_by_severity(found, ledger.totals).collect()}
    assert by_severity == {"low": 0, "medium": 0, "high": 0, "critical": 1}


def test_affected_events_are_whole(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=5).add("usage_recorded", 1, "s1")
    for n in range(30):
        book.add("dispute_lost", n, amount_cents=1)
    df = book.df(spark)
    ledger = Ledger(df, START, END)
    found = a.detect(df, ledger.subscriptions, ledger.customers, ledger.totals, BASE, REF)
    pairs = a.affected_events(found, df).join(found.select("anomaly_id", "anomaly_type"), "anomaly_id")
    counts = {r.anomaly_type: r["count"] for r in pairs.groupBy("anomaly_type").count().collect()}
    assert counts == {"missing_invoice": 2, "dispute_spike": 30}


def test_thresholds_per_tenant(spark):
    one, two = Book("t1"), Book("t2")
    for b in (one, two):
        b.add("invoice_paid", 0, event_id="x").add("invoice_paid", 100, event_id="x")
    df = one.df(spark).unionByName(two.df(spark))
    own = spark.createDataFrame([("t1", "p1", 60)], "tenant_id string, project_id string, duplicate_event_window_seconds bigint")
    assert [r.tenant_id for r in a.duplicate_events(df, own, REF).collect()] == ["t2"]
