"""Ingest: one row per rule, lenient mode, hashes, sources, sinks and the incremental run."""

from __future__ import annotations

import hashlib
import json

import pytest

from pyspark.sql import functions as F

from tallyline.functions.hashing import source_hash
from tallyline.operators import ingest as ing
from tallyline.sources import billing as files
from tallyline.streaming.ingest import ingest_new_files

NOW = "2024-02-01T00:00:00Z"
GOOD = {
    "event_id": "evt_1",
    "event_type": "invoice_paid",
    "timestamp": "2024-01-05T12:00:00.000Z",
    "customer_id": "cus_1",
    "subscription_id": "sub_1",
    "amount_cents": 5000,
    "currency": "USD",
}


def raw_df(spark, *texts, tenant="t-1", project="p_1"):
    rows = [(tenant, project, i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "tenant_id string, project_id string, ingest_seq bigint, raw string")


def run(spark, *texts, lenient=False, **scope):
    events, errors = ing.ingest(raw_df(spark, *texts, **scope), NOW, lenient)
    return events.orderBy("ingest_seq").collect(), {r.ingest_seq: r.error for r in errors.collect()}


CASES = [
    (GOOD, None),
    ("42", "Event must be an object"),
    ("null", "Event must be an object"),
    ('"text"', "Event must be an object"),
    ("{broken", "Event must be valid JSON"),
    (
        "[1]",
        "event_id: required, event_type: required, timestamp: required, customer_id: required, raw_payload: expected object",
    ),
    ({k: v for k, v in GOOD.items() if k != "customer_id"}, "customer_id: required"),
    (GOOD | {"event_id": ""}, "event_id: too short"),
    (GOOD | {"event_id": 7}, "event_id: expected string"),
    (GOOD | {"event_id": None}, "event_id: expected string"),
    (GOOD | {"event_type": "foo"}, "event_type: not in enumeration"),
    (GOOD | {"timestamp": "2024-01-05T12:00:00+02:00"}, "timestamp: invalid format"),
    (GOOD | {"timestamp": "2024-01-05"}, "timestamp: invalid format"),
    (GOOD | {"timestamp": "2024-02-30T00:00:00Z"}, "timestamp: invalid format"),
    (GOOD | {"timestamp": "2024-01-05T12:00:00Z\n"}, "timestamp: invalid format"),
    (GOOD | {"timestamp": "2024-01-05T12:00:00.123456789Z"}, None),
    (GOOD | {"amount_cents": 12.5}, "amount_cents: not an integer"),
    (GOOD | {"amount_cents": "12"}, "amount_cents: expected number"),
    (GOOD | {"amount_cents": None}, "amount_cents: expected number"),
    (GOOD | {"amount_cents": -3}, None),
    (GOOD | {"currency": "usd"}, "currency: invalid format"),
    (GOOD | {"currency": "USD\n"}, "currency: invalid format"),
    (GOOD | {"subscription_id": None}, "subscription_id: expected string"),
    (GOOD | {"subscription_id": ""}, "subscription_id: too short"),
    (GOOD | {"plan_id": ""}, None),
    (GOOD | {"plan_id": 3}, "plan_id: expected string"),
    (GOOD | {"period_start": "soon"}, "period_start: invalid format"),
    (GOOD | {"metadata": None}, None),
    (GOOD | {"metadata": [1]}, "metadata: expected object"),
    (GOOD | {"metadata": {"a": 1}}, None),
    (GOOD | {"surprise": 1, "tenant_id": "OTHER"}, None),
    (GOOD | {"customer_id": "", "currency": "x"}, "customer_id: too short, currency: invalid format"),
]


def test_every_rule(spark):
    events, errors = run(spark, *[c[0] for c in CASES])
    assert errors == {i: e for i, (_, e) in enumerate(CASES) if e is not None}
    assert [r.ingest_seq for r in events] == [i for i, (_, e) in enumerate(CASES) if e is None]


@pytest.mark.parametrize(
    "tenant, project, error",
    [
        ("T1", "p", "tenant_id: invalid format"),
        ("t1\n", "p", "tenant_id: invalid format"),
        ("t1", "P", "project_id: invalid format"),
        ("t1", "a_b-9", None),
        ("t_1", "p", "tenant_id: invalid format"),
        ("", "p", "tenant_id: too short, tenant_id: invalid format"),
    ],
)
def test_scope_of_the_caller_is_checked(spark, tenant, project, error):
    _, errors = run(spark, GOOD, tenant=tenant, project=project)
    assert errors.get(0) == error


def test_context_merge(spark):
    record = GOOD | {"tenant_id": "somebody-else", "extra": [1], "amount_cents": 5000.0}
    del record["currency"]
    events = ing.ingest(raw_df(spark, record, GOOD | {"metadata": {"k": "v"}}), NOW)[0]
    first, second = (
        events.select("tenant_id", "amount_cents", "currency", F.to_json("metadata").alias("m"), F.to_json("raw_payload").alias("r"))
        .orderBy("ingest_seq")
        .collect()
    )
    assert (first.tenant_id, first.amount_cents, first.currency, first.m) == ("t-1", 5000, None, "{}")
    assert json.loads(first.r)["tenant_id"] == "somebody-else" and json.loads(second.m) == {"k": "v"}


def expected_hash(record):
    keys = ["tenant_id", "project_id", "event_id", "event_type", "timestamp", "customer_id", "subscription_id",
            "invoice_id", "amount_cents", "currency", "plan_id"]
    full = {"tenant_id": "t-1", "project_id": "p_1"} | {k: v for k, v in record.items() if k not in ("tenant_id", "project_id")}
    text = json.dumps({k: full[k] for k in keys if k in full}, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def test_source_hash_is_the_hash_of_the_present_fields(spark):
    records = [GOOD, GOOD | {"plan_id": "é \"x\" /"}, GOOD | {"metadata": {"a": 1}, "period_start": GOOD["timestamp"]}]
    events, _ = run(spark, *records)
    assert [e.source_hash for e in events] == [expected_hash(r) for r in records]
    assert events[0].source_hash == events[2].source_hash


def test_lenient_keeps_rejected_objects_in_both(spark):
    bad = GOOD | {"currency": "usd", "event_type": "foo"}
    events, errors = run(spark, GOOD, bad, "42", lenient=True)
    assert [e.validation_errors for e in events] == [[], ["event_type: not in enumeration", "currency: invalid format"]]
    assert set(errors) == {1, 2}
    assert events[1].source_hash == expected_hash(bad)
    checked = ing.check(raw_df(spark, GOOD, bad, "42"))
    counts = ing.ingest_stats(checked, lenient=True).collect()[0]
    assert (counts.total, counts.valid, counts.invalid) == (3, 2, 2)
    strict = ing.ingest_stats(checked).collect()[0]
    assert (strict.total, strict.valid, strict.invalid) == (3, 1, 2)


def test_modes_parse_each_text_once(spark):
    """What keeps or drops a row stays above the checks, so no text is built or parsed again to filter by its kind."""
    checked = ing.check(raw_df(spark, GOOD, "42").select(*["tenant_id", "project_id", "ingest_seq"], F.upper("raw").alias("raw")))
    for lenient in (False, True):
        events = ing.events_of(checked, NOW, lenient).select("event_id", "validation_errors")
        plan = events._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("upper(") == 1


def test_first_errors_is_per_tenant(spark):
    both = raw_df(spark, *["1"] * 5).unionByName(raw_df(spark, *["2"] * 2, tenant="t-2"))
    rows = ing.first_errors(ing.errors_of(ing.check(both)), 3).collect()
    assert sorted((r.tenant_id, r.ingest_seq) for r in rows) == [("t-1", 0), ("t-1", 1), ("t-1", 2), ("t-2", 0), ("t-2", 1)]


def test_array_and_line_files_give_the_same_events(spark, tmp_path):
    records = [GOOD, GOOD | {"event_id": "evt_2"}, 17]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    results = []
    for name, layout in (("a.json", "array"), ("l.jsonl", "lines")):
        events, errors = ing.ingest(files.read_raw(spark, str(tmp_path / name), "t-1", "p_1", layout), NOW)
        results.append((sorted(r.source_hash for r in events.collect()), [r.error for r in errors.collect()]))
    assert results[0] == results[1] and len(results[0][0]) == 2 and results[0][1] == ["Event must be an object"]


def test_files_that_are_no_array_are_rejected_with_their_path(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([GOOD, GOOD | {"event_id": "evt_2"}]))
    (tmp_path / "b.json").write_text('[{"event_id": "evt_3"')
    (tmp_path / "c.json").write_text('{"event_id": "evt_4"}')
    checked = ing.check(files.read_raw(spark, str(tmp_path), "t-1", "p_1", "array"))
    assert sorted(r.event_id for r in ing.events_of(checked, NOW).collect()) == sorted(["evt_2", GOOD["event_id"]])
    errors = {r.raw.rsplit("/", 1)[1]: r.error for r in ing.errors_of(checked).collect()}
    assert errors == {"b.json": "Input file must be valid JSON", "c.json": "Input file must be an array"}


@pytest.mark.parametrize("layout", ["lines", "array"])
def test_sequence_follows_the_files(spark, tmp_path, layout):
    """Files by name, events of equal time and id by their place, also where a file is read in several blocks."""
    expected = []
    for name in ("x 1", "x 2", "y"):
        records = [GOOD | {"plan_id": f"{name}-{n}"} for n in range(400)]
        expected += [r["plan_id"] for r in records]
        text = json.dumps(records) if layout == "array" else "\n".join(map(json.dumps, records))
        (tmp_path / f"{name}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = files.read_raw(spark, str(tmp_path), "t-1", "p_1", layout)
        rows = ing.events_of(ing.check(raw), NOW).select("ingest_seq", "plan_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.plan_id for r in sorted(rows, key=lambda r: r.ingest_seq)] == expected
    assert len({r.ingest_seq for r in rows}) == len(expected)


@pytest.mark.parametrize("layout", ["parquet", "json", "orc"])
def test_event_sink_round_trip(spark, tmp_path, layout):
    events = ing.ingest(raw_df(spark, GOOD, GOOD | {"event_id": "evt_2", "timestamp": "2024-01-06T00:00:00.123456Z"}), NOW)[0]
    files.write_events(events, str(tmp_path / "out"), layout)
    schema = "event_id string, timestamp timestamp, source_hash string, raw_payload string, tenant_id string, event_date date"
    back = files.read_table(spark, str(tmp_path / "out"), layout, schema)
    assert back.select("event_id", "timestamp", "source_hash").exceptAll(events.select("event_id", "timestamp", "source_hash")).count() == 0
    assert back.where("event_date = date'2024-01-06'").count() == 1


def test_ledger_documents_are_flattened(spark, tmp_path):
    document = {
        "tenant_id": "t1",
        "project_id": "p1",
        "customers": {
            "c1": {
                "customer_id": "c1",
                "subscriptions": [
                    {"subscription_id": "s1", "customer_id": "c1", "plan_id": "a", "status": "active", "mrr_cents": 5},
                    {"subscription_id": "s2", "customer_id": "c1", "plan_id": "b", "status": "past_due", "mrr_cents": 7},
                ],
                "total_paid_cents": 3,
                "last_payment_at": "2024-01-20T09:00:00Z",
            },
            "c2": {"customer_id": "c2", "subscriptions": []},
        },
    }
    (tmp_path / "ledger.json").write_text(json.dumps(document, indent=1))
    documents = files.read_ledger(spark, str(tmp_path))
    subs = files.flatten_subscriptions(documents).orderBy("subscription_id").collect()
    assert [(s.subscription_id, s.generation, s.status, s.mrr_cents) for s in subs] == [("s1", 1, "active", 5), ("s2", 2, "past_due", 7)]
    people = {r.customer_id: r for r in files.flatten_customers(documents).collect()}
    assert people["c1"].active_subscriptions == 1 and people["c1"].subscription_count == 2
    assert people["c2"].total_paid_cents == 0 and people["c2"].payment_failure_count_30d == 0


def test_incremental_ingest_takes_only_new_files(spark, tmp_path):
    exports, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    exports.mkdir()

    def run_once():
        ingest_new_files(spark, str(exports), str(out), str(mark), "t-1", "p_1", NOW).awaitTermination()
        events = spark.read.parquet(f"{out}/events")
        return sorted(r.event_id for r in events.collect()), spark.read.parquet(f"{out}/errors").count()

    (exports / "1.jsonl").write_text(json.dumps(GOOD) + "\n42\n")
    assert run_once() == (["evt_1"], 1)
    (exports / "2.jsonl").write_text(json.dumps(GOOD | {"event_id": "evt_2"}) + "\n")
    assert run_once() == (["evt_1", "evt_2"], 1)


def test_stream_keeps_the_order_of_arrival(spark, tmp_path):
    """Events of equal time and id: by batch, files by name, rows by place, as in the batch reader."""
    exports, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    exports.mkdir()
    expected = []
    for batch, names in enumerate((["b", "a"], ["0"])):
        for name in names:
            lines = [json.dumps(GOOD | {"plan_id": f"{batch}-{name}-{n:03d}"}) for n in range(300)]
            (exports / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        expected += [f"{batch}-{name}-{n:03d}" for name in sorted(names) for n in range(300)]
        ingest_new_files(spark, str(exports), str(out), str(mark), "t-1", "p_1", NOW).awaitTermination()
    rows = spark.read.parquet(f"{out}/events").select("ingest_seq", "plan_id").collect()
    assert [r.plan_id for r in sorted(rows, key=lambda r: r.ingest_seq)] == expected
    assert len({r.ingest_seq for r in rows}) == len(expected)


def test_normalised_and_derived_hash_agree(spark, book):
    book.add("invoice_paid", 0, "s1", amount_cents=5)
    row = book.df(spark).select(source_hash().alias("h"), "timestamp_text").collect()[0]
    record = {"event_id": "e000", "event_type": "invoice_paid", "timestamp": row.timestamp_text, "customer_id": "c1",
              "subscription_id": "s1", "amount_cents": 5, "currency": "USD"}
    text = json.dumps({"tenant_id": "t1", "project_id": "p1"} | record, separators=(",", ":"))
    assert row.h == hashlib.sha256(text.encode()).hexdigest()
