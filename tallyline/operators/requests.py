"""Work queue: job request rows per tenant, their keys, preflight and dedupe.

A tenant row carries `period_start`, `period_end` (ISO text), `trace_id` and
the input paths; a NULL path means the job is not requested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.hashing import canonical_hash, canonical_json, sha256_hex
from tallyline.functions.rules import Rule, broken_rules

TENANT_PATHS = [
    "reconcile_events_path",
    "anomaly_ledger_path",
    "churn_ledger_path",
    "usage_metrics_path",
    "support_tickets_path",
]


def _file(path: str) -> Column:
    source = F.struct(F.lit("json").alias("format"), F.col(path).alias("path"), F.lit("file").alias("type"))
    return F.when(F.col(path).isNotNull(), source)


def _output(kind: str) -> Column:
    return F.concat(F.lit(f"./output/{kind}-"), "tenant_id", F.lit("-"), "project_id", F.lit(".json"))


def _payloads() -> dict[str, tuple[Column, Column]]:
    """Job type to (is requested, payload)."""
    operation = lambda name: F.lit(name).alias("operation")
    scan = F.struct(
        _file("anomaly_ledger_path").alias("ledger_source"),
        operation("anomaly_scan"),
        F.struct(_output("anomalies").alias("anomalies_path")).alias("output"),
    )
    churn = F.struct(
        F.struct(
            _file("churn_ledger_path").alias("ledger"),
            _file("support_tickets_path").alias("support_tickets"),
            _file("usage_metrics_path").alias("usage_metrics"),
        ).alias("inputs"),
        operation("churn_risk_report"),
        F.struct(_output("churn").alias("report_path")).alias("output"),
    )
    reconcile = F.struct(
        _file("reconcile_events_path").alias("events_source"),
        operation("reconcile"),
        F.struct(_output("ledger").alias("ledger_path"), _output("recon").alias("report_path")).alias("output"),
        "period_end",
        "period_start",
    )
    return {
        fixed.JOB_ANOMALY_SCAN: (F.col("anomaly_ledger_path").isNotNull(), scan),
        fixed.JOB_CHURN_RISK: (F.col("churn_ledger_path").isNotNull(), churn),
        fixed.JOB_RECONCILE: (F.col("reconcile_events_path").isNotNull(), reconcile),
    }


def cost_hooks(job_type: Column) -> Column:
    """The cost attribution block every request carries."""
    return F.struct(
        job_type.alias("capability"),
        F.struct(
            F.concat_ws(":", *SCOPE).alias("cost_center"),
            F.array(F.lit(fixed.MODULE_ID), job_type).alias("tags"),
        ).alias("cost_context"),
        F.lit(fixed.MODULE_ID).alias("module_id"),
        "project_id",
        "tenant_id",
    )


def job_requests(tenants: DataFrame, requested_at: str = fixed.STABLE_TIMESTAMP) -> DataFrame:
    """Up to three request rows per tenant; equal work has an equal idempotency key."""
    entries = []
    for job, (wanted, payload) in _payloads().items():
        identity = F.to_json(F.struct(F.lit(job).alias("job_type"), payload.alias("payload"), "project_id", "tenant_id"))
        entries.append(
            F.when(
                wanted,
                F.struct(
                    F.lit(job).alias("job_type"),
                    F.to_json(payload).alias("payload"),
                    canonical_hash(identity).alias("idempotency_key"),
                    F.lit(fixed.JOB_TIMEOUTS[job]).alias("timeout_seconds"),
                ),
            )
        )
    metadata = F.struct(
        cost_hooks(F.col("job_type")).alias("finops_hooks"),
        F.lit("AVAILABLE").alias("job_type_status"),
        F.lit(True).alias(fixed.DRY_RUN_FIELD),
        F.lit(fixed.MODULE_ID).alias("module_id"),
        F.lit(False).alias("requires_policy_token"),
        "trace_id",
    )
    return tenants.select(*SCOPE, "trace_id", F.inline(F.array_compact(F.array(*entries)))).select(
        *SCOPE,
        "trace_id",
        "job_type",
        F.concat(F.lit("job-"), F.substring("idempotency_key", 1, 16)).alias("job_id"),
        F.lit(requested_at).alias("requested_at"),
        canonical_json(F.col("payload")).alias("payload"),
        F.lit("normal").alias("priority"),
        F.lit(fixed.JOB_MAX_RETRIES).alias("max_retries"),
        "timeout_seconds",
        F.to_json(metadata).alias("metadata"),
        "idempotency_key",
    )


def standalone_requests(
    tenants: DataFrame, requested_at: str, triggered_by: str, priority: str = "normal", max_retries: int = 3
) -> DataFrame:
    """Requests outside a bundle: the payload carries hooks, thresholds or weights and its own limits.

    The ids of critical findings to look at first are a table of their own
    (`priority_ids`), since their number grows with the tenant.
    """
    constants = lambda values: F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
    extra = {
        fixed.JOB_ANOMALY_SCAN: [
            F.col("anomaly_ledger_path").alias("ledger_path"),
            constants(fixed.SCAN_THRESHOLDS).alias("thresholds"),
        ],
        fixed.JOB_CHURN_RISK: [constants(fixed.CHURN_WEIGHTS).alias("weights")],
        fixed.JOB_RECONCILE: [],
    }
    notes = {
        fixed.JOB_ANOMALY_SCAN: F.lit(None).cast("string"),
        fixed.JOB_CHURN_RISK: F.lit(fixed.CHURN_NOTE),
        fixed.JOB_RECONCILE: F.concat(F.lit("Events source: "), "reconcile_events_path"),
    }
    entries = []
    for job, (wanted, payload) in _payloads().items():
        more = F.struct(
            cost_hooks(F.lit(fixed.STANDALONE_CAPABILITIES[job])).alias("finops_hooks"),
            F.lit(max_retries).alias("max_retries"),
            F.lit(fixed.JOB_TIMEOUTS[job]).alias("timeout_seconds"),
            *extra[job],
        )
        basic, added = F.to_json(payload), F.to_json(more)
        joined = F.concat(F.substring(basic, F.lit(1), F.length(basic) - 1), F.lit(","), F.substr(added, F.lit(2)))
        entries.append(
            F.when(
                wanted,
                F.struct(
                    F.lit(job).alias("job_type"),
                    canonical_json(joined).alias("payload"),
                    F.to_json(F.struct(notes[job].alias("notes"), F.lit(triggered_by).alias("triggered_by"))).alias(
                        "metadata"
                    ),
                ),
            )
        )
    identity = sha256_hex(F.concat_ws(":", "job_type", *SCOPE, "payload"))
    return tenants.select(*SCOPE, F.inline(F.array_compact(F.array(*entries)))).select(
        *SCOPE,
        "job_type",
        F.concat(F.lit("job-"), F.substring(identity, 1, 16)).alias("job_id"),
        F.lit(requested_at).alias("requested_at"),
        "payload",
        F.lit(priority).alias("priority"),
        F.lit(fixed.JOB_MAX_RETRIES).alias("max_retries"),
        F.lit(300).alias("timeout_seconds"),
        "metadata",
    )


def request_bundles(requests: DataFrame) -> DataFrame:
    """One bundle per tenant and trace with its canonical hash; at most three requests each."""
    plain = ["idempotency_key", "job_id", "job_type", "max_retries", "priority", "project_id", "requested_at"]
    head = F.to_json(F.struct(*plain, "tenant_id", "timeout_seconds"))
    one = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"metadata":'),
        "metadata",
        F.lit(',"payload":'),
        "payload",
        F.lit("}"),
    )
    listed = requests.groupBy(*SCOPE, "trace_id").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.array_sort(F.collect_list(F.struct("job_type", one.alias("json")))).alias("items"),
    )
    frame = F.to_json(
        F.struct(
            F.struct("job_count").alias("metadata"),
            F.lit(fixed.MODULE_ID).alias("module_id"),
            "project_id",
            F.lit(fixed.CONTRACT_VERSION).alias("schema_version"),
            "tenant_id",
            "trace_id",
        )
    )
    text = F.concat(
        F.substring(frame, F.lit(1), F.length(frame) - 1),
        F.lit(',"requests":['),
        F.array_join(F.transform("items", lambda i: i["json"]), ","),
        F.lit("]}"),
    )
    return listed.withColumn("bundle", canonical_json(text)).select(
        *SCOPE, "trace_id", "job_count", "bundle", sha256_hex(F.col("bundle")).alias("canonical_hash")
    )


def priority_ids(anomalies: DataFrame, risks: DataFrame) -> DataFrame:
    """Critical anomalies and customers per tenant, one row each."""
    return (
        anomalies.where(F.col("severity") == "critical")
        .select(*SCOPE, F.lit("priority_anomaly_ids").alias("list"), F.col("anomaly_id").alias("id"))
        .unionByName(
            risks.where(F.col("risk_level") == "critical").select(
                *SCOPE, F.lit("priority_customer_ids").alias("list"), F.col("customer_id").alias("id")
            )
        )
    )


def request_violations(requests: DataFrame, bundles: DataFrame) -> DataFrame:
    """Preflight: every rule a request breaks, given the bundle (`bundle_id`) it came in.

    Broken form stops the check: only well-formed requests in well-formed
    bundles are checked for their meaning.
    """
    missing = lambda name: F.col(name).isNull() | (F.col(name) == "")
    form = [
        Rule("bundle.schema_version", "unsupported", F.coalesce(F.col("schema_version") != fixed.CONTRACT_VERSION, F.lit(True))),
        Rule("bundle.tenant_id", "required", missing("bundle_tenant_id")),
        Rule("bundle.project_id", "required", missing("bundle_project_id")),
        Rule("tenant_id", "required", missing("tenant_id")),
        Rule("project_id", "required", missing("project_id")),
        Rule("idempotency_key", "required", missing("idempotency_key")),
        Rule("job_type", "required", missing("job_type")),
    ]
    held = F.try_parse_json("payload")
    has_action = F.lit(False)
    for name in fixed.ACTION_FIELDS:
        has_action = has_action | F.try_variant_get(held, f"$.{name}", "variant").isNotNull()
    about = F.try_parse_json("metadata")
    token = F.try_variant_get(about, "$.requires_policy_token", "variant")
    needs_token = (F.schema_of_variant(token) == "BOOLEAN") & F.try_variant_get(token, "$", "boolean")
    status = F.try_variant_get(about, "$.job_type_status", "string")
    meaning = [
        Rule("tenant_id", "differs from bundle", F.col("tenant_id") != F.col("bundle_tenant_id")),
        Rule("project_id", "differs from bundle", F.col("project_id") != F.col("bundle_project_id")),
        Rule("payload", "action without policy token", has_action & ~F.coalesce(needs_token, F.lit(False))),
        Rule(
            "job_type",
            "unknown without UNAVAILABLE status",
            ~F.col("job_type").isin(fixed.JOB_TYPES) & (F.coalesce(status, F.lit("")) != "UNAVAILABLE"),
        ),
    ]
    named = bundles.select(
        "bundle_id",
        "schema_version",
        F.col("tenant_id").alias("bundle_tenant_id"),
        F.col("project_id").alias("bundle_project_id"),
    )
    return (
        requests.join(named, "bundle_id")
        .withColumn("of_form", broken_rules(form))
        .withColumn("found", F.when(F.size("of_form") > 0, F.col("of_form")).otherwise(broken_rules(meaning)))
        .select("bundle_id", "job_id", F.explode("found").alias("violation"))
    )


def dedupe_requests(requests: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The earliest request of every idempotency key, without the keys already done."""
    fields = F.struct("requested_at", *[c for c in requests.columns if c not in ("idempotency_key", "requested_at")])
    first = requests.groupBy("idempotency_key").agg(F.min(fields).alias("kept"), F.count(F.lit(1)).alias("copies"))
    if done is not None:
        first = first.join(done.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    return first.select("kept.*", "idempotency_key", "copies").select(*requests.columns, "copies")
