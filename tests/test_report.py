"""Golden hashes, findings, report lines, requests, bundles and their preflight."""

from __future__ import annotations

import hashlib
import json

import pytest

from conftest import END, REF, START, Book, T0

from pyspark.sql import functions as F

from tallyline import ChurnInputs, analyze, fixed
from tallyline.functions.hashing import canonical_hash, canonical_json
from tallyline.operators import report, requests

PERIOD = ("2024-01-01T00:00:00.000Z", "2024-01-31T23:59:59.999Z")
TENANT_SCHEMA = (
    "tenant_id string, project_id string, trace_id string, period_start string, period_end string, "
    "reconcile_events_path string, anomaly_ledger_path string, churn_ledger_path string, "
    "usage_metrics_path string, support_tickets_path string"
)
# fixed value: the input folder inside the hashed golden payloads
FOLDER = "./fixtures/jobforge"


def demo_tenant(spark, **changes):
    row = dict(
        tenant_id="tenant-demo",
        project_id="project-demo",
        trace_id="trace-demo",
        period_start=PERIOD[0],
        period_end=PERIOD[1],
        reconcile_events_path=f"{FOLDER}/events.json",
        anomaly_ledger_path=f"{FOLDER}/ledger.json",
        churn_ledger_path=f"{FOLDER}/ledger.json",
        usage_metrics_path=f"{FOLDER}/usage-metrics.json",
        support_tickets_path=None,
    )
    return spark.createDataFrame([tuple((row | changes).values())], TENANT_SCHEMA)


def demo_events(spark):
    book = Book("tenant-demo")
    more = dict(project_id="project-demo", customer_id="cus_demo", amount_cents=5000)
    book.add("subscription_created", 0, "sub_demo", plan_id="plan_basic", **more)
    book.add("invoice_paid", 100, "sub_demo", invoice_id="inv_demo", **more)
    return book.df(spark)


def test_golden_request_keys(spark):
    rows = {r.job_type: r for r in requests.job_requests(demo_tenant(spark)).collect()}
    assert {k: r.idempotency_key for k, r in rows.items()} == {
        fixed.JOB_ANOMALY_SCAN: "acb55eb487e9858329c6a68afd85274a93c66bd2de27d26876dc8065ede62deb",
        fixed.JOB_CHURN_RISK: "55efe2ee5f4b6b1495779da1497bd2b74d7566cfeac54b74b112996df62a3299",
        fixed.JOB_RECONCILE: "11c9dbd33de9f3491727cf61914f3706a5e54d7060082eacceb8137ed0a484a7",
    }
    assert rows[fixed.JOB_ANOMALY_SCAN].job_id == "job-acb55eb487e98583"
    assert rows[fixed.JOB_CHURN_RISK].timeout_seconds == 600


def test_golden_bundle_hash(spark):
    bundle = requests.request_bundles(requests.job_requests(demo_tenant(spark))).collect()[0]
    assert bundle.job_count == 3
    assert bundle.canonical_hash == "87750bdc3f20d6055b2e61925be22bf4f1704d57b91245074be7ed9f1e3c5b52"


def test_golden_report(spark):
    queue = requests.job_requests(demo_tenant(spark))
    result = analyze(demo_events(spark), *PERIOD, requests=queue)
    summary = result.summary.collect()[0]
    assert (summary.event_count, summary.ledger_customer_count, summary.ledger_mrr_cents) == (2, 1, 5000)
    assert (summary.anomaly_count, summary.reconciliation_discrepancies, summary.job_request_count) == (0, 0, 3)
    envelope = result.envelopes("trace-demo").collect()[0]
    assert envelope.report_id == "finops-report-001fcc70100e"
    whole = result.documents("trace-demo").collect()[0]
    assert whole.document_hash == "19099764fc45c8c26c1f33848137909904d1290ff5f9aa6d566c42ec6039936f"
    lines = [r.line for r in result.lines("trace-demo", title="T").orderBy("line_no").collect()]
    assert lines == [
        "# T", "", "- Tenant: tenant-demo", "- Project: project-demo", "- Trace: trace-demo",
        "- Generated: 1970-01-01T00:00:00.000Z", "", "## Summary", "",
        f"- Period: {PERIOD[0]} to {PERIOD[1]}", "- Events: 2", "- Normalized events: 2", "- Customers: 1",
        "- MRR (cents): 5000", "- Reconciliation discrepancies: 0", "- Anomalies: 0", "- Churn risks: 0",
        "- Job requests: 3", "", "## Findings", "", "- No findings produced.", "", "## Recommendations", "",
        "- No recommendations generated.", "", "## Canonicalization", "", "- Algorithm: sha256",
        "- Format: json-stable", f"- Hash: {envelope.canonical_hash}",
    ]


def analysis(spark):
    book = Book()
    book.add("subscription_created", 0, "s1", amount_cents=5000).add("payment_failed", 1)
    book.add("subscription_created", 0, "s2", amount_cents=300, customer_id="c2")
    book.add("subscription_cancelled", 0, "s9", customer_id="c3").add("subscription_created", 5, "s9", customer_id="c3")
    df = book.df(spark)
    from tallyline import Ledger

    ledger = Ledger(df, START, END)
    scope = "tenant_id string, project_id string, customer_id string"
    inputs = ChurnInputs(
        ledger.customers,
        spark.createDataFrame([], f"{scope}, metric_name string, previous_value double, current_value double, period_days int, seq bigint"),
        spark.createDataFrame([], f"{scope}, severity string, status string"),
        spark.createDataFrame([("t1", "p1", "c1", T0, 1)], f"{scope}, changed_at timestamp, seq bigint"),
        REF,
    )
    return analyze(df, START, END, REF, churn_inputs=inputs)


def test_findings_order_shape_and_severity(spark):
    result = analysis(spark)
    rows = report.rank_findings(result.findings).orderBy("finding_rank").collect()
    order = [fixed.FINDING_SEVERITY_ORDER.index(r.severity) for r in rows]
    assert order == sorted(order) and [r.finding_rank for r in rows] == list(range(1, len(rows) + 1))
    recon = {r.finding_id: (r.severity, r.description, r.evidence) for r in rows if r.category == "reconciliation"}
    assert recon["recon-s1"][0] == "high" and recon["recon-s2"][0] == "medium"
    assert recon["recon-s2"][1] == "Detected missing_invoice with 300 cents difference."
    assert recon["recon-s2"][2] == ["subscription_id: s2", "difference_cents: 300", "reason: missing_invoice"]
    # every risk is a finding, low ones too
    assert sum(r.category == "churn" for r in rows) == result.risks.count() == 3
    texts = [r.recommendation for r in result.recommendations.collect()]
    assert len(texts) == len(set(texts)) and "Engagement: Send re-activation campaign" in texts


def test_document_hash_is_the_hash_of_the_canonical_report(spark):
    result = analysis(spark)
    envelope = result.envelopes("trace-1").collect()[0]
    ranks = report.rank_findings(result.findings).orderBy("finding_rank").collect()
    summary = result.summary.drop("tenant_id", "project_id").collect()[0].asDict()
    document = {
        "schema_version": "1.0.0", "module_id": "finops", "tenant_id": "t1", "project_id": "p1", "trace_id": "trace-1",
        "report_id": envelope.report_id, "generated_at": fixed.STABLE_TIMESTAMP, "report_type": "finops",
        "summary": summary,
        "findings": [
            dict(finding_id=r.finding_id, title=r.title, description=r.description, severity=r.severity,
                 category=r.category, evidence=r.evidence, metadata={})
            for r in ranks
        ],
        "recommendations": sorted(r.recommendation for r in result.recommendations.collect()),
        "metadata": {"event_envelope_count": 0, "run_manifest_count": 0},
    }
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert result.documents("trace-1").collect()[0].document_hash == hashlib.sha256(text.encode()).hexdigest()


def digest_of(texts: list[str]) -> str:
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    sums = [str(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes)) for i in range(8)]
    return hashlib.sha256(":".join([str(len(texts)), *sums]).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 3, 20_000])
def test_one_kind_of_hash_at_every_size(spark, n):
    result = analysis(spark)
    made = spark.range(n).select(
        F.lit("t1").alias("tenant_id"), F.lit("p1").alias("project_id"), F.concat(F.lit("f"), "id").alias("finding_id"),
        F.lit("T").alias("title"), F.lit("D").alias("description"), F.lit("low").alias("severity"),
        F.lit("churn").alias("category"), F.array(F.lit("e")).alias("evidence"),
    )
    make = lambda df: report.report_envelopes(result.summary, df, result.recommendations, F.lit("t")).collect()[0]
    row = make(made.repartition(5))
    plan = report.report_envelopes(result.summary, made, result.recommendations, F.lit("t"))
    assert "finding_rank" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert row.finding_count == n and row == make(made.orderBy(F.desc("finding_id")))
    head = report._headed(result.summary, result.recommendations, F.lit("t"), fixed.STABLE_TIMESTAMP).first().head
    texts = [
        f'{{"category":"churn","description":"D","evidence":["e"],"finding_id":"f{i}","metadata":{{}},"severity":"low","title":"T"}}'
        for i in range(n)
    ]
    assert row.canonical_hash == hashlib.sha256(f"{head}|{digest_of(texts)}".encode()).hexdigest()


def test_default_period(spark):
    tenants = spark.createDataFrame([("t1", "p1"), ("t9", "p1")], "tenant_id string, project_id string")
    rows = {r.tenant_id: r for r in report.report_period(tenants, Book().add("dispute_won", 0).df(spark)).collect()}
    assert rows["t9"].period_start == fixed.DEFAULT_PERIOD_START and rows["t9"].period_end == fixed.DEFAULT_PERIOD_END
    assert rows["t1"].period_start == rows["t1"].period_end == "2024-01-10T00:00:00.000000Z"


def test_only_requested_jobs(spark):
    rows = requests.job_requests(demo_tenant(spark, reconcile_events_path=None, churn_ledger_path=None)).collect()
    assert [r.job_type for r in rows] == [fixed.JOB_ANOMALY_SCAN]


def test_canonical_json_sorts_every_level(spark):
    text = '{"b":[{"z":1,"a":null}],"a":{"d":2,"c":true}}'
    row = spark.createDataFrame([(text,)], "j string").select(canonical_json(F.col("j")).alias("c"), canonical_hash(F.col("j")).alias("h")).collect()[0]
    assert row.c == '{"a":{"c":true,"d":2},"b":[{"a":null,"z":1}]}'
    assert row.h == hashlib.sha256(row.c.encode()).hexdigest()


def violations(spark, bundle=None, **request):
    base = dict(bundle_id="b1", job_id="j1", job_type=fixed.JOB_RECONCILE, tenant_id="t1", project_id="p1",
                idempotency_key="k", payload="{}", metadata="{}") | request
    held = dict(bundle_id="b1", schema_version="1.0.0", tenant_id="t1", project_id="p1") | (bundle or {})
    make = lambda row: spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return [r.violation for r in requests.request_violations(make(base), make(held)).collect()]


def test_request_preflight(spark):
    assert violations(spark) == []
    assert violations(spark, bundle={"schema_version": "2"}) == ["bundle.schema_version: unsupported"]
    assert violations(spark, bundle={"tenant_id": None}) == ["bundle.tenant_id: required"]
    assert violations(spark, tenant_id=None) == ["tenant_id: required"]
    assert violations(spark, tenant_id="t2", project_id="p2") == ["tenant_id: differs from bundle", "project_id: differs from bundle"]
    assert violations(spark, idempotency_key="") == ["idempotency_key: required"]
    for field in fixed.ACTION_FIELDS:
        payload = json.dumps({field: None})
        assert violations(spark, payload=payload) == ["payload: action without policy token"]
        assert violations(spark, payload=payload, metadata='{"requires_policy_token":true}') == []
        assert violations(spark, payload=payload, metadata='{"requires_policy_token":"true"}') != []
    assert violations(spark, job_type="x.y") == ["job_type: unknown without UNAVAILABLE status"]
    assert violations(spark, job_type="x.y", metadata='{"job_type_status":"UNAVAILABLE"}') == []


def test_dedupe_keeps_the_earliest_and_skips_done(spark):
    schema = "tenant_id string, requested_at string, idempotency_key string"
    rows = spark.createDataFrame([("t1", "2", "a"), ("t1", "1", "a"), ("t1", "1", "b")], schema)
    kept = requests.dedupe_requests(rows, rows.where("idempotency_key = 'b'")).collect()
    assert [(r.requested_at, r.idempotency_key, r.copies) for r in kept] == [("1", "a", 2)]


def test_standalone_requests_carry_hooks_and_limits(spark):
    rows = {r.job_type: r for r in requests.standalone_requests(demo_tenant(spark), REF, "me", max_retries=5).collect()}
    scan = json.loads(rows[fixed.JOB_ANOMALY_SCAN].payload)
    assert scan["finops_hooks"]["capability"] == "anomaly_detect" and scan["max_retries"] == 5
    assert scan["thresholds"] == fixed.SCAN_THRESHOLDS and scan["ledger_path"] == f"{FOLDER}/ledger.json"
    churn = json.loads(rows[fixed.JOB_CHURN_RISK].payload)
    assert churn["weights"] == fixed.CHURN_WEIGHTS and churn["timeout_seconds"] == 600 and "support_tickets" not in churn["inputs"]
    assert json.loads(rows[fixed.JOB_RECONCILE].metadata)["notes"] == f"Events source: {FOLDER}/events.json"
