"""Plans and skew: the heavy-key paths give the same rows, plans have no cross joins or full collects."""

from __future__ import annotations

import pytest
from conftest import DATA, END, REF, START, Book

from pyspark.sql import functions as F

from tallyline.functions import materialise, ordered, skew
from tallyline.functions.ordered import ordered_scan
from tallyline.functions.ranking import ranked
from tallyline.functions.thresholds import Thresholds
from tallyline.operators import anomalies as a
from tallyline.operators import ledger as ledgers
from tallyline.operators import reconcile
from tallyline.plans.catalog import Inputs, all_queries
from tallyline.sources import derived


def same(x, y) -> bool:
    return x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


@pytest.fixture
def all_heavy(monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 0)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.0)


@pytest.fixture
def half_heavy(monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 12)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.0)


def pipeline(spark):
    i = Inputs(spark, DATA)
    heavy = skew.HeavyKeys(i.billing)
    book = ledgers.Ledger(i.billing, derived.PERIOD_START, derived.PERIOD_END, heavy)
    found = reconcile.discrepancies(book.subscriptions, book.customers, heavy.of(ledgers.CUSTOMER))
    anomalies = a.detect(i.billing, book.subscriptions, book.customers, book.totals, Thresholds(), REF, heavy)
    downgrades = derived.plan_downgrades(i.billing, heavy)
    pairs = a.affected_events(anomalies, i.billing, heavy)
    return [book.subscriptions, book.customers, found, anomalies, downgrades, pairs]


@pytest.mark.parametrize("mode", ["all_heavy", "half_heavy"])
def test_heavy_paths_equal_plain_paths(spark, request, mode):
    plain = [sorted(map(str, t.collect())) for t in pipeline(spark)]
    request.getfixturevalue(mode)
    heavy = [sorted(map(str, t.collect())) for t in pipeline(spark)]
    assert plain == heavy and all(plain)


def test_no_heavy_keys_on_ordinary_data(spark):
    i = Inputs(spark, DATA)
    assert i.heavy.of(ledgers.SUBSCRIPTION) is None


def test_heavy_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 5)
    df = spark.range(100).select(F.when(F.col("id") < 50, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 25)).alias("k"))
    assert [r.k for r in skew.HeavyKeys(df).of(["k"]).collect()] == ["hot"]


def test_sketches_find_every_heavy_key(spark, monkeypatch):
    """More keys than a sketch tells apart: none above the share escapes, few others are taken."""
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 10)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.01)
    monkeypatch.setattr(skew, "TRACKED", 1024)
    monkeypatch.setattr(skew, "MOST_HEAVY", 100)
    n = F.col("id")
    hot = F.when(n % 2 == 0, F.concat(F.lit("hot"), n % 40)).otherwise(F.concat(F.lit("k"), n % 30011))
    df = spark.range(0, 200_000, 1, 13).select(F.lit("t").alias("tenant_id"), hot.alias("k"), (n % 3).alias("m"))
    heavy = skew.HeavyKeys(df).look_up(["tenant_id", "k"], ["tenant_id", "m"])
    assert {tuple(r) for r in heavy.of(["tenant_id", "k"]).collect()} == {("t", f"hot{i}") for i in range(0, 40, 2)}
    assert {tuple(r) for r in heavy.of(["tenant_id", "m"]).collect()} == {("t", 0), ("t", 1), ("t", 2)}
    parts = [skew.key_sketches(df.where(F.col("m") == k), ["tenant_id", "k"]) for k in range(3)]
    kept = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = skew.HeavyKeys(df, kept).of(["tenant_id", "k"])
    assert same(merged, heavy.of(["tenant_id", "k"]))
    text = plan(kept)
    assert "hashpartitioning(tenant_id" not in text and "hashpartitioning(k" not in text


def test_null_and_odd_keys_are_never_heavy(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 1)
    rows = [("t", None)] * 9 + [(None, "x")] * 9 + [("t", "a\x1fb")] * 9 + [("t", "")] * 9
    df = spark.createDataFrame(rows, "tenant_id string, k string")
    assert [tuple(r) for r in skew.HeavyKeys(df).of(["tenant_id", "k"]).collect()] == [("t", "")]
    assert skew.HeavyKeys(df.limit(0)).of(["tenant_id", "k"]) is None


def test_ordered_scan_slices(spark):
    rows = [("k", n * 20, n, n % 3 == 0) for n in range(60)]
    df = spark.createDataFrame(rows, "k string, sec long, id long, flag boolean").withColumn("t", F.timestamp_seconds("sec"))
    args = (df, ["k"], ["t", "id"], {"seen": F.col("flag")}, {"before": "id"})
    assert same(ordered_scan(*args), ordered_scan(*args, heavy=df.select("k").distinct()))


def test_one_second_spreads_over_slices(spark, monkeypatch):
    """All rows of a key at one time: slices follow the whole order."""
    monkeypatch.setattr("tallyline.functions.ordered.SLICE_ROWS", 50)
    rows = [("k" if n % 3 else "other", 7, n * 7919 % 2003, n % 4 == 0) for n in range(2000)]
    df = spark.createDataFrame(rows, "k string, sec long, id long, flag boolean").withColumn("t", F.timestamp_seconds("sec"))
    df = df.unionByName(df.limit(3).withColumn("k", F.lit(None).cast("string")).withColumn("id", F.col("id") + 5000))
    args = (df, ["k"], ["t", "id"], {"seen": F.col("flag")}, {"before": "id"})
    kept = []
    plain_store = ordered.store
    monkeypatch.setattr(ordered, "store", lambda rows: kept.append(plain_store(rows)) or kept[-1])
    heavy = spark.createDataFrame([("k",)], "k string")
    assert same(ordered_scan(*args), ordered_scan(*args, heavy=heavy))
    sizes = [r["count"] for r in kept[0].groupBy("slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 400 and sum(sizes) == df.where("k = 'k'").count()


def test_one_customer_with_a_third_of_all_rows(spark, monkeypatch):
    """A hot subscription, event id and invoice at once, heavy path against plain path."""
    book = Book()
    for n in range(240):
        hot = n % 3 == 0
        book.add(
            ("subscription_created", "subscription_updated", "subscription_cancelled", "invoice_paid")[n // 3 % 4],
            (n * 37) % 500,
            "hot" if hot else f"s{n}",
            event_id="hot" if hot else f"e{n}",
            customer_id="hot" if hot else f"c{n % 40}",
            invoice_id="hot" if hot else f"i{n % 50}",
            amount_cents=n % 5 * 100,
        )
    df = book.df(spark)

    def tables():
        heavy = skew.HeavyKeys(df)
        ledger = ledgers.Ledger(df, START, END, heavy)
        return [
            ledger.subscriptions,
            ledger.customers,
            reconcile.discrepancies(ledger.subscriptions, ledger.customers, heavy.of(ledgers.CUSTOMER)),
            a.detect(df, ledger.subscriptions, ledger.customers, ledger.totals, Thresholds(), REF, heavy),
        ]

    plain = [sorted(map(str, t.collect())) for t in tables()]
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 20)
    heavy = [sorted(map(str, t.collect())) for t in tables()]
    assert plain == heavy and all(plain)


def test_rank_over_chunks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    rows = ranked(df.repartition(7), ["g"], [F.col("v").desc()], "r").collect()
    for g in range(3):
        values = sorted((r.r, r.v) for r in rows if r.g == g)
        assert [r for r, _ in values] == list(range(1, len(values) + 1))
        assert [v for _, v in values] == sorted((v for _, v in values), reverse=True)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stats_carry_no_payloads(spark):
    """Counting events computes neither hashes nor metadata; the rules run once per row."""
    text = plan(all_queries()["ingest_stats"](spark, DATA))
    assert "sha2" not in text and "AS metadata" not in text and "variant_to_json" not in text
    assert text.count("Generate inline") == plan(all_queries()["ingest_events"](spark, DATA)).count("Generate inline")


def test_period_reaches_the_scan(spark):
    text = plan(all_queries()["ledger_period_events"](spark, DATA))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_copies_are_cut_before_the_shuffle(spark):
    text = plan(a.duplicate_events(Inputs(spark, DATA).billing, Thresholds(), REF))
    assert "row_number(), 2, Partial" in text


def test_scans_read_only_needed_columns(spark):
    text = plan(all_queries()["cost_by_customer"](spark, DATA))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in text


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch, tmp_path):
    """Few splits of many rows are cut to more tasks than there are cores; every row stays."""
    path = str(tmp_path / "t.parquet")
    spark.range(0, 10_000, 1, 1).write.parquet(path)
    table = spark.read.parquet(path)
    assert materialise.spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(materialise, "TASK_ROWS", 300)
    tasks = materialise.spread(table)
    sizes = [r.n for r in tasks.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert tasks.rdd.getNumPartitions() == 34 and sum(sizes) == 10_000 and max(sizes) < 600
    assert same(tasks, table)


def test_report_derives_events_and_ledger_once(spark, monkeypatch):
    """One derivation of the events, one pass for heavy keys and one ledger, which is that of the period's events."""
    made = {"views": 0, "sketches": 0, "ledgers": 0}

    def counted(name, fn):
        def call(*args, **more):
            made[name] += 1
            return fn(*args, **more)

        return call

    i = Inputs(spark, DATA)
    own = i.period_ledger.customers.collect()
    monkeypatch.setattr(skew, "HEAVY_FLOOR", 1)
    monkeypatch.setattr(derived, "billing_view", counted("views", derived.billing_view))
    monkeypatch.setattr(skew, "key_sketches", counted("sketches", skew.key_sketches))
    monkeypatch.setattr(ledgers.Ledger, "__init__", counted("ledgers", ledgers.Ledger.__init__))
    result = Inputs(spark, DATA).analysis()
    assert made == {"views": 1, "sketches": 1, "ledgers": 1}
    assert sorted(map(str, result.ledger.customers.collect())) == sorted(map(str, own))
    assert result.risks.count() == len(own)
