"""Ledger and reconciliation: pinned rows, a sequential fold, order independence."""

from __future__ import annotations

import hashlib
import json

from conftest import DATA, END, START, Book, at

from pyspark.sql import functions as F

from tallyline.operators import reconcile
from tallyline.operators.ledger import Ledger
from tallyline.plans.catalog import Inputs
from tallyline.sources import derived


def subs(spark, book):
    rows = Ledger(book.df(spark), START, END).subscriptions.collect()
    return {(r.subscription_id, r.generation): r for r in rows}


def customers(spark, book):
    return {r.customer_id: r for r in Ledger(book.df(spark), START, END).customers.collect()}


def test_created_defaults(spark, book):
    book.add("subscription_created", 0, "s1", currency=None)
    row = subs(spark, book)["s1", 1]
    assert (row.status, row.mrr_cents, row.plan_id, row.currency) == ("active", 0, "unknown", "USD")
    assert row.current_period_start == row.current_period_end == row.created_at


def test_empty_texts_count_as_absent(spark, book):
    book.add("subscription_created", 0, "s1", plan_id="", currency="", amount_cents=500)
    book.add("subscription_updated", 1, "s1", plan_id="", currency="", amount_cents=None)
    row = subs(spark, book)["s1", 1]
    assert (row.plan_id, row.currency, row.mrr_cents) == ("unknown", "USD", 500)


def test_update_overwrites_with_zero_and_keeps_last_non_empty(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=500, plan_id="a")
    book.add("subscription_updated", 1, "s1", plan_id="b")
    book.add("subscription_updated", 2, "s1", amount_cents=0)
    row = subs(spark, book)["s1", 1]
    assert (row.mrr_cents, row.plan_id) == (0, "b")


def test_recreation_opens_second_row_and_both_count(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100)
    book.add("subscription_created", 1, "s1", amount_cents=200, customer_id="c2")
    book.add("subscription_updated", 2, "s1", amount_cents=250)
    rows = subs(spark, book)
    assert rows["s1", 1].mrr_cents == 100 and rows["s1", 1].status == "active"
    assert rows["s1", 2].mrr_cents == 250 and rows["s1", 2].customer_id == "c2"
    assert customers(spark, book)["c1"].total_mrr_cents == 100


def test_cancel_keeps_status_through_updates_and_takes_last_cancel_time(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100)
    book.add("subscription_cancelled", 1, "s1")
    book.add("subscription_updated", 2, "s1", amount_cents=300)
    book.add("subscription_cancelled", 3, "s1")
    row = subs(spark, book)["s1", 1]
    assert (row.status, row.mrr_cents) == ("canceled", 300)
    assert row.canceled_at.timestamp() == at(3).timestamp()


def test_events_before_creation_or_without_subscription_are_ignored(spark, book):
    book.add("subscription_updated", 0, "s1", customer_id="early")
    book.add("subscription_cancelled", 0, "s1", customer_id="early")
    book.add("subscription_created", 1, None, customer_id="nobody")
    book.add("subscription_created", 2, "", customer_id="nobody")
    book.add("subscription_created", 3, "s1")
    assert set(subs(spark, book)) == {("s1", 1)}
    assert set(customers(spark, book)) == {"c1"}


def test_cancel_touches_the_events_own_customer(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100)
    book.add("subscription_cancelled", 5, "s1", customer_id="c9")
    rows = customers(spark, book)
    assert rows["c9"].updated_at.timestamp() == at(5).timestamp()
    assert rows["c9"].subscription_count == 0 and rows["c1"].subscription_count == 1


def test_customer_sums_and_times(spark, book):
    book.add("invoice_paid", 1, amount_cents=100)
    book.add("invoice_paid", 3, amount_cents=None)
    book.add("invoice_refunded", 4, amount_cents=30)
    book.add("refund_issued", 5, amount_cents=999)
    book.add("invoice_disputed", 6, amount_cents=7)
    book.add("dispute_created", 7, amount_cents=999)
    book.add("payment_failed", 8)
    book.add("payment_succeeded", 9, amount_cents=50)
    row = customers(spark, book)["c1"]
    assert (row.total_paid_cents, row.total_refunded_cents, row.total_disputed_cents) == (100, 30, 7)
    assert row.payment_failure_count_30d == 1
    assert row.last_invoice_at.timestamp() == at(3).timestamp()
    assert row.last_payment_at.timestamp() == at(9).timestamp()


def test_ignored_types_make_no_customer(spark, book):
    for kind in ("invoice_failed", "usage_recorded", "refund_issued", "dispute_created", "dispute_won", "dispute_lost"):
        book.add(kind, 1, customer_id="ghost")
    assert customers(spark, book) == {}
    totals = Ledger(book.df(spark), START, END).totals.collect()[0]
    assert (totals.total_customers, totals.event_count, totals.total_mrr_cents) == (0, 6, 0)


def test_period_is_inclusive_and_event_count_is_not_limited(spark, book):
    edge = at(100).strftime("%Y-%m-%dT%H:%M:%SZ")
    first = at(0).strftime("%Y-%m-%dT%H:%M:%SZ")
    book.add("invoice_paid", 0, amount_cents=1).add("invoice_paid", 100, amount_cents=2)
    book.add("invoice_paid", 101, amount_cents=4).add("invoice_paid", -1, amount_cents=8)
    ledger = Ledger(book.df(spark), first, edge)
    assert ledger.customers.collect()[0].total_paid_cents == 3
    assert ledger.totals.collect()[0].event_count == 4


def found(spark, book):
    ledger = Ledger(book.df(spark), START, END)
    rows = reconcile.discrepancies(ledger.subscriptions, ledger.customers).collect()
    return [(r.subscription_id, r.observed_mrr_cents, r.difference_cents, r.reason) for r in rows]


def test_discrepancy_needs_more_than_tolerance(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=200).add("invoice_paid", 1, amount_cents=100)
    assert found(spark, book) == []
    book.add("subscription_updated", 2, "s1", amount_cents=201)
    assert found(spark, book) == [("s1", 100, 101, "missing_invoice")]


def test_payments_are_not_shared_out_and_canceled_rows_are_skipped(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=500).add("subscription_created", 0, "s2", amount_cents=500)
    book.add("subscription_created", 0, "s3", amount_cents=9000).add("subscription_cancelled", 1, "s3")
    book.add("invoice_paid", 2, amount_cents=500)
    assert found(spark, book) == []


def test_missing_payment_event(spark, book):
    book.add("payment_failed", 0).add("payment_failed", 1)
    book.add("payment_failed", 0, customer_id="c2").add("payment_succeeded", 1, customer_id="c2")
    rows = reconcile.missing_payments(Ledger(book.df(spark), START, END).customers, END).collect()
    assert [(r.event_id, r.failure_count) for r in rows] == [("missing-payment-c1", 2)]


def test_balanced_tenant(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=500).add("invoice_paid", 1, amount_cents=500)
    ledger = Ledger(book.df(spark), START, END)
    none = reconcile.discrepancies(ledger.subscriptions, ledger.customers)
    missing = reconcile.missing_payments(ledger.customers, END)
    row = reconcile.recon_summary(ledger.totals, none, missing, START, END).collect()[0]
    assert row.is_balanced and row.total_difference_cents == 0
    assert row.report_id == f"recon-t1-p1-{START}-{END}"


def test_report_hash_is_the_same_digest_at_every_size(spark, book):
    for n in range(4):
        book.add("subscription_created", n, f"s{n}", amount_cents=500)
    ledger = Ledger(book.df(spark), START, END)
    rows = reconcile.discrepancies(ledger.subscriptions, ledger.customers)
    one = reconcile.report_hashes(ledger.totals, rows, START, END).collect()[0]
    again = reconcile.report_hashes(ledger.totals, rows.repartition(3), START, END).collect()[0]
    many = spark.range(20_000).select(
        F.lit("t1").alias("tenant_id"), F.lit("p1").alias("project_id"), F.col("id").cast("string").alias("subscription_id"),
        F.lit(1).cast("long").alias("difference_cents"), F.lit("r").alias("reason"),
    )
    long = reconcile.report_hashes(ledger.totals, many, START, END)
    assert one == again and one.discrepancy_count == 4
    assert "collect_list" not in long._jdf.queryExecution().optimizedPlan().toString()
    assert long.columns == [*one.asDict()] and long.first().discrepancy_count == 20_000
    listed = [(r.subscription_id, r.difference_cents, r.reason) for r in rows.orderBy("customer_id", "subscription_id").collect()]
    document = {
        "tenant_id": "t1", "project_id": "p1", "period_start": START, "period_end": END,
        "discrepancies": [dict(zip(("subscription_id", "difference_cents", "reason"), x)) for x in listed],
    }
    whole = reconcile.document_hashes(ledger.totals, rows, START, END).collect()[0]
    assert whole.document_hash == hashlib.sha256(json.dumps(document, separators=(",", ":")).encode()).hexdigest()


def fold(events, start, end):
    """The same ledger, one event after the other."""
    people, open_subs, all_subs = {}, {}, []

    def person(e):
        return people.setdefault(
            (e.tenant_id, e.customer_id), dict(paid=0, refunded=0, disputed=0, failed=0, invoice=None, payment=None, updated=None)
        )

    for e in sorted(events, key=lambda e: (e.timestamp, e.event_id, e.ingest_seq)):
        if not start <= e.timestamp <= end:
            continue
        kind, key = e.event_type, (e.tenant_id, e.subscription_id)
        if kind == "subscription_created" and e.subscription_id:
            sub = dict(key=key, owner=e.customer_id, plan=e.plan_id or "unknown", mrr=e.amount_cents or 0,
                       currency=e.currency or "USD", status="active", created=e.timestamp, canceled=None)
            open_subs[key] = sub
            all_subs.append(sub)
            person(e)["updated"] = e.timestamp
        elif kind == "subscription_updated" and key in open_subs:
            sub = open_subs[key]
            sub["plan"] = e.plan_id or sub["plan"]
            sub["currency"] = e.currency or sub["currency"]
            sub["mrr"] = sub["mrr"] if e.amount_cents is None else e.amount_cents
            person(e)["updated"] = e.timestamp
        elif kind == "subscription_cancelled" and key in open_subs:
            open_subs[key] |= dict(status="canceled", canceled=e.timestamp)
            person(e)["updated"] = e.timestamp
        elif kind in ("invoice_paid", "invoice_refunded", "invoice_disputed"):
            who = person(e)
            who[{"invoice_paid": "paid", "invoice_refunded": "refunded", "invoice_disputed": "disputed"}[kind]] += e.amount_cents or 0
            who["updated"] = e.timestamp
            if kind == "invoice_paid":
                who["invoice"] = e.timestamp
        elif kind == "payment_succeeded":
            person(e).update(payment=e.timestamp, updated=e.timestamp)
        elif kind == "payment_failed":
            who = person(e)
            who["failed"] += 1
            who["updated"] = e.timestamp
    return people, all_subs


def test_ledger_equals_a_sequential_fold(spark):
    i = Inputs(spark, DATA)
    events = i.billing.collect()
    a, b = (spark.sql(f"select timestamp '{t}'").collect()[0][0] for t in (derived.PERIOD_START, derived.PERIOD_END))
    people, all_subs = fold(events, a, b)
    rows = i.ledger.subscriptions.collect()
    ours = sorted(
        (r.tenant_id, r.subscription_id, r.customer_id, r.plan_id, r.mrr_cents, r.currency, r.status, str(r.created_at), str(r.canceled_at))
        for r in rows
    )
    theirs = sorted(
        (*s["key"], s["owner"], s["plan"], s["mrr"], s["currency"], s["status"], str(s["created"]), str(s["canceled"]))
        for s in all_subs
    )
    assert ours == theirs and len(ours) > 50
    customers_now = {
        (r.tenant_id, r.customer_id): (r.total_paid_cents, r.total_refunded_cents, r.total_disputed_cents,
                                       r.payment_failure_count_30d, r.last_invoice_at, r.last_payment_at, r.updated_at)
        for r in i.ledger.customers.collect()
    }
    assert customers_now == {
        k: (p["paid"], p["refunded"], p["disputed"], p["failed"], p["invoice"], p["payment"], p["updated"])
        for k, p in people.items()
    }


def test_input_order_and_split_do_not_matter(spark):
    i = Inputs(spark, DATA)
    plain = i.ledger.subscriptions
    mixed = Ledger(i.billing.orderBy(F.rand(7)).repartition(5), derived.PERIOD_START, derived.PERIOD_END).subscriptions
    assert plain.exceptAll(mixed).count() == 0 and mixed.exceptAll(plain).count() == 0


def test_tenants_do_not_affect_each_other(spark):
    one, two = Book("t1"), Book("t2")
    for b, amount in ((one, 100), (two, 900)):
        b.add("subscription_created", 0, "s1", amount_cents=amount).add("invoice_paid", 1, amount_cents=amount)
    both = Ledger(one.df(spark).unionByName(two.df(spark)), START, END).customers
    alone = Ledger(one.df(spark), START, END).customers.unionByName(Ledger(two.df(spark), START, END).customers)
    assert both.exceptAll(alone).count() == 0 and both.count() == alone.count() == 2
