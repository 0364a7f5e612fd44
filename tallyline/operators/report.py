"""Findings, recommendations, summary and the rendered report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE, iso_micros
from tallyline.functions.hashing import digest_sums, digest_text, sha256_hex, tree_hashes
from tallyline.functions.periods import Periods
from tallyline.functions.ranking import ranked

HIGH_DIFFERENCE_CENTS = 1000
SEVERITY_RANK = {name: i for i, name in enumerate(fixed.FINDING_SEVERITY_ORDER)}


def report_period(tenants: DataFrame, events: DataFrame) -> DataFrame:
    """First and last event time per tenant, else the default period."""
    spans = events.groupBy(*SCOPE).agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    return tenants.select(*SCOPE).join(spans, SCOPE, "left").select(
        *SCOPE,
        F.coalesce(iso_micros(F.col("first_at")), F.lit(fixed.DEFAULT_PERIOD_START)).alias("period_start"),
        F.coalesce(iso_micros(F.col("last_at")), F.lit(fixed.DEFAULT_PERIOD_END)).alias("period_end"),
    )


def analysis_periods(given: DataFrame, events: DataFrame) -> Periods:
    """The period of every tenant of `given` (scope, period_start, period_end, reference_date; each may be null).

    Missing ends come from the tenant's events (`report_period`). A missing reference date
    is the end of the period.
    """
    derived = report_period(given, events).select(*SCOPE, *[F.col(c).alias(f"of_events_{c}") for c in ("period_start", "period_end")])
    ends = [F.coalesce(c, f"of_events_{c}").alias(c) for c in ("period_start", "period_end")]
    return Periods(given.join(derived, SCOPE).select(*SCOPE, *ends, "reference_date"))


def _finding(df: DataFrame, finding_id, title, description, severity, category, evidence, tie) -> DataFrame:
    return df.select(
        *SCOPE,
        finding_id.alias("finding_id"),
        title.alias("title"),
        description.alias("description"),
        severity.alias("severity"),
        F.lit(category).alias("category"),
        F.array(*evidence).alias("evidence"),
        tie.cast("bigint").alias("tie"),
    )


def findings(discrepancies: DataFrame, anomalies: DataFrame, risks: DataFrame | None = None) -> DataFrame:
    """Discrepancies, anomalies and every churn risk in one shape."""
    text = lambda name: F.col(name).cast("string")
    label = lambda tag, name: F.concat(F.lit(f"{tag}: "), text(name))
    parts = [
        _finding(
            discrepancies,
            F.concat(F.lit("recon-"), "subscription_id"),
            F.concat(F.lit("MRR discrepancy for "), "subscription_id"),
            F.concat(
                F.lit("Detected "), "reason", F.lit(" with "), text("difference_cents"), F.lit(" cents difference.")
            ),
            F.when(F.abs("difference_cents") > HIGH_DIFFERENCE_CENTS, "high").otherwise("medium"),
            "reconciliation",
            [
                label("subscription_id", "subscription_id"),
                label("difference_cents", "difference_cents"),
                label("reason", "reason"),
            ],
            F.col("generation"),
        ),
        _finding(
            anomalies,
            F.col("anomaly_id"),
            F.concat(F.lit("Anomaly: "), F.replace(F.col("anomaly_type"), F.lit("_"), F.lit(" "))),
            F.col("description"),
            F.col("severity"),
            "anomaly",
            [label("anomaly_id", "anomaly_id"), label("type", "anomaly_type")],
            F.lit(0),
        ),
    ]
    if risks is not None:
        parts.append(
            _finding(
                risks,
                F.col("risk_id"),
                F.concat(F.lit("Churn risk: "), "customer_id"),
                F.col("explanation"),
                F.col("risk_level"),
                "churn",
                [label("customer_id", "customer_id"), label("risk_level", "risk_level")],
                F.lit(0),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _severity_rank() -> Column:
    pairs = [F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col("severity"))


def rank_findings(found: DataFrame) -> DataFrame:
    """Most severe first, then by id, with `finding_rank`."""
    order = [_severity_rank(), F.col("finding_id"), F.col("tie"), F.col("description")]
    return ranked(found, SCOPE, order, "finding_rank")


def recommendations(anomalies: DataFrame, risks: DataFrame | None = None) -> DataFrame:
    """The distinct recommended actions of a tenant; the texts are a fixed set of sixteen."""
    texts = anomalies.where(F.col("recommended_action").isNotNull()).select(
        *SCOPE, F.col("recommended_action").alias("recommendation")
    )
    if risks is not None:
        texts = texts.unionByName(risks.select(*SCOPE, F.explode("recommended_actions").alias("recommendation")))
    return texts.distinct()


def _count(df: DataFrame | None, name: str, scopes: DataFrame) -> DataFrame:
    if df is None:
        return scopes.select(*SCOPE, F.lit(0).cast("bigint").alias(name))
    return df.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias(name))


def report_summary(
    periods: DataFrame,
    totals: DataFrame,
    discrepancies: DataFrame,
    anomalies: DataFrame,
    risks: DataFrame | None = None,
    requests: DataFrame | None = None,
    raw_counts: DataFrame | None = None,
) -> DataFrame:
    """Ten counters per tenant of `periods`.

    `event_count` counts raw events (`raw_counts`: scope and `raw_event_count`),
    `normalized_event_count` those that passed ingest.
    """
    ledger = totals.select(
        *SCOPE,
        F.col("event_count").alias("normalized_event_count"),
        F.col("total_customers").alias("ledger_customer_count"),
        F.col("total_mrr_cents").alias("ledger_mrr_cents"),
    )
    counted = [
        _count(discrepancies, "reconciliation_discrepancies", periods),
        _count(anomalies, "anomaly_count", periods),
        _count(risks, "churn_risk_count", periods),
        _count(requests, "job_request_count", periods),
    ]
    if raw_counts is None:
        raw_counts = totals.select(*SCOPE, F.col("event_count").alias("raw_event_count"))
    wide = reduce(lambda a, b: a.join(b, SCOPE, "left"), [raw_counts, ledger, *counted], periods)
    names = ["raw_event_count", *ledger.columns[2:]] + [c.columns[2] for c in counted]
    return wide.select(
        *SCOPE,
        "period_start",
        "period_end",
        *[
            F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("event_count" if n == "raw_event_count" else n)
            for n in names
        ],
    )


def report_id() -> Column:
    return F.concat(
        F.lit(fixed.REPORT_ID_PREFIX),
        F.substring(sha256_hex(F.to_json(F.struct("project_id", "tenant_id", "trace_id"))), 1, 12),
    )


SUMMARY_FIELDS = [
    "anomaly_count",
    "churn_risk_count",
    "event_count",
    "job_request_count",
    "ledger_customer_count",
    "ledger_mrr_cents",
    "normalized_event_count",
    "period_end",
    "period_start",
    "reconciliation_discrepancies",
]


def _finding_json() -> Column:
    """A finding as the report's document has it."""
    entry = F.struct(
        "category",
        "description",
        "evidence",
        "finding_id",
        F.create_map().cast("map<string,string>").alias("metadata"),
        "severity",
        "title",
    )
    return F.to_json(entry)


def _headed(summary: DataFrame, advice: DataFrame, trace_id: Column, generated_at: str) -> DataFrame:
    """The summary with trace, report id, and `head`: the document without its findings."""
    texts = advice.groupBy(*SCOPE).agg(F.array_sort(F.collect_list("recommendation")).alias("recommendations"))
    head = F.to_json(
        F.struct(
            F.lit(generated_at).alias("generated_at"),
            F.struct(F.lit(0).alias("event_envelope_count"), F.lit(0).alias("run_manifest_count")).alias("metadata"),
            F.lit(fixed.MODULE_ID).alias("module_id"),
            "project_id",
            "recommendations",
            "report_id",
            F.lit(fixed.REPORT_TYPE).alias("report_type"),
            F.lit(fixed.CONTRACT_VERSION).alias("schema_version"),
            F.struct(*SUMMARY_FIELDS).alias("summary"),
            "tenant_id",
            "trace_id",
        )
    )
    return (
        summary.withColumn("trace_id", trace_id)
        .withColumn("report_id", report_id())
        .join(texts, SCOPE, "left")
        .withColumn("recommendations", F.coalesce("recommendations", F.array().cast("array<string>")))
        .withColumn("head", head)
    )


def report_envelopes(
    summary: DataFrame,
    findings: DataFrame,
    advice: DataFrame,
    trace_id: Column,
    generated_at: str = fixed.STABLE_TIMESTAMP,
) -> DataFrame:
    """Report id and canonical hash per tenant.

    The hash covers the document's head and the order-free digest of the findings,
    at every size alike; `document_hashes` gives the hash of the whole document.
    """
    sized = findings.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("finding_count"), *digest_sums(sha256_hex(_finding_json()))
    )
    n = F.coalesce("finding_count", F.lit(0))
    return (
        _headed(summary, advice, trace_id, generated_at)
        .join(sized, SCOPE, "left")
        .select(
            *SCOPE,
            "trace_id",
            "report_id",
            F.lit(generated_at).alias("generated_at"),
            n.alias("finding_count"),
            sha256_hex(F.concat_ws("|", "head", digest_text(n))).alias("canonical_hash"),
        )
    )


def document_hashes(
    summary: DataFrame,
    ranked_findings: DataFrame,
    advice: DataFrame,
    trace_id: Column,
    generated_at: str = fixed.STABLE_TIMESTAMP,
) -> DataFrame:
    """Export: the SHA-256 of each tenant's whole report as one canonical JSON document.

    A document is one value, so a tenant's findings meet in one group.
    """
    listed = (
        ranked_findings.groupBy(*SCOPE)
        .agg(F.array_sort(F.collect_list(F.struct("finding_rank", _finding_json().alias("json")))).alias("items"))
        .select(*SCOPE, F.array_join(F.transform("items", lambda i: i["json"]), ",").alias("findings_json"))
    )
    # "findings" sorts before every other key of the document
    document = F.concat(
        F.lit('{"findings":['),
        F.coalesce("findings_json", F.lit("")),
        F.lit("],"),
        F.substring(F.col("head"), F.lit(2), F.length("head")),
    )
    return (
        _headed(summary, advice, trace_id, generated_at)
        .join(listed, SCOPE, "left")
        .select(*SCOPE, "trace_id", "report_id", sha256_hex(document).alias("document_hash"))
    )


def report_tree_hashes(
    summary: DataFrame,
    ranked_findings: DataFrame,
    advice: DataFrame,
    trace_id: Column,
    generated_at: str = fixed.STABLE_TIMESTAMP,
) -> DataFrame:
    """Export: a hash of each tenant's report with its findings in order, at any size of a tenant.

    It covers the document's head and the tree hash of the ranked findings.
    """
    placed = ranked_findings.withColumn("place", F.col("finding_rank") - 1)
    listed = tree_hashes(placed, SCOPE, "place", sha256_hex(_finding_json()))
    none = sha256_hex(F.lit(""))
    return (
        _headed(summary, advice, trace_id, generated_at)
        .join(listed, SCOPE, "left")
        .select(
            *SCOPE, "report_id", sha256_hex(F.concat_ws("|", "head", F.coalesce("tree_hash", none))).alias("report_tree_hash")
        )
    )


def report_lines(
    summary: DataFrame,
    envelopes: DataFrame,
    ranked_findings: DataFrame,
    advice: DataFrame,
    title: str = "Billing Report",
) -> DataFrame:
    """The Markdown report as numbered lines per tenant.

    Line numbers follow from the finding rank and counts, so no tenant's lines
    have to meet in one task.
    """
    head = summary.join(envelopes, SCOPE)
    n_advice = advice.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("advice_count"))
    labelled = lambda label, name: F.concat(F.lit(f"- {label}: "), F.col(name).cast("string"))
    opening = [
        F.lit(f"# {title}"),
        F.lit(""),
        labelled("Tenant", "tenant_id"),
        labelled("Project", "project_id"),
        labelled("Trace", "trace_id"),
        labelled("Generated", "generated_at"),
        F.lit(""),
        F.lit("## Summary"),
        F.lit(""),
        F.concat(F.lit("- Period: "), "period_start", F.lit(" to "), "period_end"),
        labelled("Events", "event_count"),
        labelled("Normalized events", "normalized_event_count"),
        labelled("Customers", "ledger_customer_count"),
        labelled("MRR (cents)", "ledger_mrr_cents"),
        labelled("Reconciliation discrepancies", "reconciliation_discrepancies"),
        labelled("Anomalies", "anomaly_count"),
        labelled("Churn risks", "churn_risk_count"),
        labelled("Job requests", "job_request_count"),
        F.lit(""),
        F.lit("## Findings"),
        F.lit(""),
    ]
    sized = head.join(n_advice, SCOPE, "left").withColumn("advice_count", F.coalesce("advice_count", F.lit(0)))
    advice_at = F.lit(len(opening)) + F.greatest(F.col("finding_count") * 3, F.lit(1))
    closing_at = advice_at + 3 + F.greatest(F.col("advice_count"), F.lit(1))

    def block(at: Column, lines: list[Column]) -> Column:
        entry = [
            F.when(line.isNotNull(), F.struct((at + i + 1).cast("bigint").alias("line_no"), line.alias("line")))
            for i, line in enumerate(lines)
        ]
        return F.array_compact(F.array(*entry))

    frame = F.concat(
        block(F.lit(0), opening),
        block(F.lit(len(opening)), [F.when(F.col("finding_count") == 0, "- No findings produced.")]),
        block(advice_at, [F.lit(""), F.lit("## Recommendations"), F.lit("")]),
        block(advice_at + 3, [F.when(F.col("advice_count") == 0, "- No recommendations generated.")]),
        block(
            closing_at,
            [
                F.lit(""),
                F.lit("## Canonicalization"),
                F.lit(""),
                F.lit("- Algorithm: sha256"),
                F.lit("- Format: json-stable"),
                labelled("Hash", "canonical_hash"),
            ],
        ),
    )
    fixed_lines = sized.select(*SCOPE, F.inline(frame))
    finding_lines = ranked_findings.select(
        *SCOPE,
        F.inline(
            block(
                F.lit(len(opening)) + (F.col("finding_rank") - 1) * 3,
                [
                    F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), "title"),
                    F.concat(F.lit("  - "), "description"),
                    F.concat(F.lit("  - Evidence: "), F.array_join("evidence", "; ")),
                ],
            )
        ),
    )
    listed = advice.groupBy(*SCOPE).agg(F.array_sort(F.collect_list("recommendation")).alias("texts"))
    advice_lines = (
        sized.withColumn("advice_at", advice_at)
        .join(listed, SCOPE)
        .select(*SCOPE, "advice_at", F.posexplode("texts").alias("i", "text"))
        .select(
            *SCOPE,
            (F.col("advice_at") + 4 + F.col("i")).cast("bigint").alias("line_no"),
            F.concat(F.lit("- "), "text").alias("line"),
        )
    )
    return fixed_lines.unionByName(finding_lines).unionByName(advice_lines)
