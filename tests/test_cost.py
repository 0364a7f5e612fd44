"""Cost snapshots: golden totals, refusals, freezing, digests."""

from __future__ import annotations

import pytest
from conftest import END, START, Book

from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.operators import cost
from tallyline.operators.ledger import Ledger

A, B = "2024-01-01T00:00:00Z", "2024-01-31T23:59:59Z"
AS_OF = "2024-03-01T00:00:00Z"


def requests(spark, tenant="t1", a=A, b=B, has_ledger=False):
    return spark.createDataFrame(
        [(tenant, "p1", a, b, has_ledger)],
        "tenant_id string, project_id string, period_start string, period_end string, has_ledger boolean",
    )


@pytest.fixture
def golden(book):
    book.add("subscription_created", 0, "sub_1", amount_cents=5000, plan_id="pro", customer_id="cus_1")
    book.add("usage_recorded", 1, "sub_1", amount_cents=1500, customer_id="cus_1")
    book.add("invoice_refunded", 2, "sub_2", amount_cents=-2500, customer_id="cus_2", invoice_id="inv_9")
    return book


def test_golden_snapshot(spark, golden):
    df = golden.df(spark)
    snapshot = cost.cost_snapshots(cost.assess_requests(requests(spark), df), df, AS_OF).collect()[0]
    assert (snapshot.total_cost_cents, snapshot.event_count) == (4000, 3)
    assert (snapshot.customer_count, snapshot.subscription_count) == (2, 2)
    assert snapshot.cached and snapshot.currency == "USD" and len(snapshot.cache_key) == 64
    items = cost.line_items(df)
    by_category = {r.category: r.amount_cents for r in cost.cost_by_category(items).collect()}
    assert by_category == {"subscription": 5000, "usage": 1500, "refund": -2500, "dispute": 0, "other": 0}
    assert "Refund inv_9 - -2500 cents" in [r.description for r in items.collect()]
    by_customer = {r.customer_id: r.amount_cents for r in cost.cost_by_customer(items).collect()}
    assert by_customer == {"cus_1": 6500, "cus_2": -2500}


def test_line_item_texts(spark, book):
    book.add("subscription_updated", 0, None).add("invoice_paid", 1).add("dispute_created", 2, invoice_id="i")
    book.add("dispute_won", 3).add("refund_issued", 4)
    rows = sorted(cost.line_items(book.df(spark)).collect(), key=lambda r: r.event_id)
    assert [(r.category, r.description, r.amount_cents) for r in rows] == [
        ("subscription", "Subscription undefined - unknown", 0),
        ("subscription", "Invoice payment unknown", 0),
        ("dispute", "Dispute i", 0),
        ("other", "Event dispute_won", 0),
        ("refund", "Refund unknown - 0 cents", 0),
    ]


def refusal(spark, df, **kwargs):
    return cost.assess_requests(requests(spark, **kwargs), df).collect()[0].refusal


def test_refusals_in_order(spark, book):
    empty = book.add("dispute_won", 0).df(spark).limit(0)
    assert refusal(spark, empty) == fixed.REFUSE_NO_DATA
    assert refusal(spark, empty, has_ledger=True) == fixed.REFUSE_NO_EVENTS
    assert refusal(spark, book.df(spark), a=B, b=B) == fixed.REFUSE_PERIOD
    assert refusal(spark, book.df(spark)) is None
    book.add("dispute_won", 1, currency=None).add("dispute_won", 1, currency="")
    assert refusal(spark, book.df(spark)) is None
    book.add("dispute_won", 2, currency="EUR")
    assert refusal(spark, book.df(spark), a=B, b=A) == fixed.REFUSE_CURRENCY


def test_currency_defaults_to_usd(spark, book):
    df = book.add("dispute_won", 0, currency=None).df(spark)
    assert cost.cost_snapshots(cost.assess_requests(requests(spark), df), df, AS_OF).collect()[0].currency == "USD"


def test_ledger_source_includes_canceled(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100, plan_id="a").add("subscription_cancelled", 1, "s1")
    ledger = Ledger(book.df(spark), A, B)
    rows = cost.line_items(cost.cost_events(None, ledger.subscriptions)).collect()
    assert [(r.event_id, r.amount_cents, r.description) for r in rows] == [("derived_s1", 100, "Subscription s1 - a")]
    given = book.df(spark).limit(0)
    tenants = ledger.subscriptions.select("tenant_id", "project_id")
    assert cost.cost_events(given, ledger.subscriptions, tenants).count() == 0


def test_digest_ignores_order_and_sees_every_change(spark, golden):
    df = golden.df(spark)
    one = cost.input_digests(df).collect()
    assert one == cost.input_digests(df.orderBy(F.desc("event_id")).repartition(3)).collect()
    changed = df.withColumn("amount_cents", F.when(F.col("event_id") == "e001", 1501).otherwise(F.col("amount_cents")))
    assert one != cost.input_digests(changed).collect()
    assert one != cost.input_digests(df.unionByName(df)).collect()


def test_frozen_periods_with_a_stored_key_are_skipped(spark):
    schema = "tenant_id string, project_id string, period_start string, period_end string, cache_key string"
    wanted = spark.createDataFrame(
        [
            ("t1", "p1", A, "2024-01-30T00:00:00Z", "old-known"),
            ("t1", "p1", A, "2024-01-30T00:00:00Z", "old-unknown"),
            ("t1", "p1", A, "2024-02-29T00:00:00Z", "edge-known"),
            ("t1", "p1", A, "2024-02-29T12:00:00Z", "new-known"),
        ],
        schema,
    )
    stored = wanted.where(F.col("cache_key").endswith("-known")).select("cache_key")
    again = [r.cache_key for r in cost.stale_snapshots(wanted, stored, AS_OF).collect()]
    assert sorted(again) == ["edge-known", "new-known", "old-unknown"]
    assert cost.stale_snapshots(wanted, stored, AS_OF, force=True).count() == 4


def test_snapshot_line_items_only_for_accepted(spark, golden):
    df = golden.df(spark)
    both = requests(spark).unionByName(requests(spark, a=B, b=A))
    assessed = cost.assess_requests(both, df)
    items = cost.snapshot_line_items(cost.line_items(df), assessed.where(F.col("refusal").isNull()))
    assert items.count() == 3


def test_each_tenant_has_events_or_its_ledger(spark):
    one, two, three = Book("t1"), Book("t2"), Book("t3")
    for b in (one, two, three):
        b.add("subscription_created", 0, "s1", amount_cents=700, plan_id="p")
    everything = one.df(spark).unionByName(two.df(spark)).unionByName(three.df(spark))
    subscriptions = Ledger(everything, START, END).subscriptions
    given = spark.createDataFrame([("t1", "p1"), ("t3", "p1")], "tenant_id string, project_id string")
    rows = cost.cost_events(one.df(spark), subscriptions, given).select("tenant_id", "event_id").collect()
    assert sorted(map(tuple, rows)) == [("t1", "e000"), ("t2", "derived_s1")]
    without = cost.cost_events(one.df(spark), subscriptions).select("tenant_id").collect()
    assert sorted(r.tenant_id for r in without) == ["t1", "t2", "t3"]
