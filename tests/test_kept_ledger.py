"""The ledger kept up to date: loads in any split and order give the ledger of all events at once."""

from __future__ import annotations

import random
import tempfile

import pytest
from compare import rows_of_spark
from conftest import END, START, Book
from pyspark.sql import functions as F

from tallyline.operators.ledger import Ledger
from tallyline.plans.kept_ledger import KeptLedger
from tallyline.plans.stored_results import DONE, SNAPSHOTS, finish_requests, store_snapshots
from tallyline.sources.versions import Conflict, VersionedTables

TABLES = ["subscriptions", "customers", "totals"]


def kept(spark):
    return KeptLedger(spark, tempfile.mkdtemp(prefix="kept-"), START, END, buckets=4)


def many_events(seed: int, n: int = 120) -> Book:
    pick = random.Random(seed)
    kinds = ["subscription_created", "subscription_updated", "subscription_cancelled", "invoice_paid", "payment_failed"]
    book = Book()
    for _ in range(n):
        book.add(
            pick.choice(kinds),
            pick.randrange(40),  # many events of one instant
            pick.choice(["s1", "s2", "s3", "", None]),
            tenant_id=pick.choice(["t1", "t2"]),
            customer_id=pick.choice(["c1", "c2", None]),
            amount_cents=pick.choice([None, 0, 100, 250]),
            plan_id=pick.choice([None, "", "a", "b"]),
        )
    book.add("subscription_created", 90 * 86400, "s9")  # outside the period, counted as an event
    return book


def assert_same(one, other):
    for name in TABLES:
        assert rows_of_spark(getattr(one, name)) == rows_of_spark(getattr(other, name)), name


@pytest.mark.parametrize("seed", [1])
def test_three_loads_in_any_order_equal_one(spark, seed):
    events = many_events(seed).df(spark)
    book = kept(spark)
    part = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(3))
    for n in (2, 0, 1):
        assert book.load(events.where(part == n), f"load-{n}")
    assert_same(book, Ledger(events, START, END))


def test_late_creation_splits_a_generation(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100, plan_id="a")
    book.add("subscription_updated", 20, "s1", amount_cents=300, customer_id="c2")
    book.add("subscription_created", 10, "s1", amount_cents=200, customer_id="c3")  # late
    book.add("subscription_updated", -5, "s2", amount_cents=7)
    book.add("subscription_updated", 5, "s2", amount_cents=8)
    book.add("subscription_created", 0, "s2", amount_cents=9)  # late: one of the two counts now
    events, ledger = book.df(spark), kept(spark)
    early = F.col("event_id").isin("e000", "e001", "e003", "e004")
    ledger.load(events.where(early), "first")
    assert {(r.subscription_id, r.mrr_cents) for r in ledger.subscriptions.collect()} == {("s1", 300)}
    ledger.load(events.where(~early), "second")
    rows = {(r.subscription_id, r.generation): r.mrr_cents for r in ledger.subscriptions.collect()}
    assert rows == {("s1", 1): 100, ("s1", 2): 300, ("s2", 1): 8}
    assert_same(ledger, Ledger(events, START, END))


def test_a_repeated_load_counts_once(spark, book):
    book.add("subscription_created", 0, "s1", amount_cents=100).add("invoice_paid", 1, amount_cents=70)
    ledger = kept(spark)
    assert ledger.load(book.df(spark), "day-1")
    assert not ledger.load(book.df(spark), "day-1")
    assert not KeptLedger(spark, ledger.folder, START, END, buckets=4).load(book.df(spark), "day-1")
    assert_same(ledger, Ledger(book.df(spark), START, END))


def test_empty_loads(spark, book):
    ledger = kept(spark)
    assert ledger.load(book.df(spark), "nothing")
    assert [getattr(ledger, t).count() for t in TABLES] == [0, 0, 0]
    book.add("subscription_created", 0, "s1")
    ledger.load(book.df(spark), "something")
    ledger.load(book.df(spark).limit(0), "nothing again")
    assert_same(ledger, Ledger(book.df(spark), START, END))


def test_a_crash_before_the_manifest_changes_nothing(spark, book, monkeypatch):
    book.add("subscription_created", 0, "s1", amount_cents=100)
    ledger = kept(spark)
    ledger.load(book.df(spark), "day-1")
    more = Book().add("subscription_updated", 5, "s1", amount_cents=900, ingest_seq=50).df(spark)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(VersionedTables, "_commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            ledger.load(more, "day-2")
    again = KeptLedger(spark, ledger.folder, START, END, buckets=4)
    assert_same(again, Ledger(book.df(spark), START, END))
    assert again.load(more, "day-2")
    assert_same(again, Ledger(book.df(spark).unionByName(more), START, END))
    assert again.tables.vacuum(versions=1, older_than_hours=-1) > 0
    assert_same(again, Ledger(book.df(spark).unionByName(more), START, END))


def test_of_two_writers_one_is_told(spark):
    folder = tempfile.mkdtemp(prefix="tables-")
    one, other = VersionedTables(spark, folder, 4), VersionedTables(spark, folder, 4)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    first, second = one.change("x"), other.change("y")
    first.replace("t", rows, ["k"])
    second.replace("t", rows.limit(1), ["k"])
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    change = VersionedTables(spark, folder, 4).change("y")
    change.replace("t", spark.createDataFrame([(None, "d"), (3, "e")], "k int, v string"), ["k"])
    change.commit()
    found = VersionedTables(spark, folder, 4).read("t").collect()
    assert sorted((r.k or 0, r.v) for r in found) == [(0, "d"), (1, "a"), (2, "b"), (3, "e")]




def test_work_lost_in_a_crash_is_done_again_and_counted_once(spark):
    folder = tempfile.mkdtemp(prefix="done-")
    rows = [("k1", "2024-01-02", "a"), ("k1", "2024-01-01", "b"), ("k2", "2024-01-01", "c")]
    asked = spark.createDataFrame(rows, "idempotency_key string, requested_at string, job_id string")
    worked: list[str] = []

    def crash(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        finish_requests(VersionedTables(spark, folder, 4), asked, "run-1", crash)
    for run in ("run-1", "run-1", "run-2"):
        finish_requests(
            VersionedTables(spark, folder, 4), asked, run, lambda df: worked.extend(r.job_id for r in df.collect())
        )
    assert sorted(worked) == ["b", "c"]
    done = VersionedTables(spark, folder, 4).read(DONE).collect()
    assert sorted((r.idempotency_key, r.job_id, r.copies, r.done_by) for r in done) == [
        ("k1", "b", 2, "run-1"), ("k2", "c", 1, "run-1"),
    ]


def test_a_changed_snapshot_replaces_the_stored_one(spark):
    folder = tempfile.mkdtemp(prefix="snapshots-")
    schema = "tenant_id string, project_id string, period_start string, period_end string, cache_key string"
    day = ("t", "p", "2024-01-01T00:00:00Z", "2024-01-01T23:59:59Z")
    for run, key in (("a", "k1"), ("b", "k1"), ("c", "k2")):
        wanted = spark.createDataFrame([(*day, key)], schema)
        store_snapshots(VersionedTables(spark, folder, 4), wanted, "2024-02-01T00:00:00Z", run)
        found = [(r.cache_key, r.stored_by) for r in VersionedTables(spark, folder, 4).read(SNAPSHOTS).collect()]
        assert found == {"a": [("k1", "a")], "b": [("k1", "a")], "c": [("k2", "c")]}[run]
