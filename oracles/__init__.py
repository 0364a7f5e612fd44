"""DuckDB SQL for every query that SQL can express, keyed like the queries."""

from __future__ import annotations

from oracles import findings as fd
from oracles import periods  # noqa: F401
from oracles.parts import PARTS, PERIOD_A, PERIOD_B, REFERENCE, iso, sql, ts

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


SCOPE = "tenant_id, project_id"

# -- sources and sinks -----------------------------------------------------------
oracle("src_billing_events", f"""
SELECT {SCOPE}, event_id, event_type, {iso('"timestamp"')} AS "timestamp", customer_id, subscription_id, invoice_id,
  amount_cents, currency, plan_id, ingest_seq FROM billing""")
oracle("src_ledger_flatten", f"""
SELECT {SCOPE}, subscription_id, customer_id, plan_id, status, {iso('created_at')} AS current_period_start,
  {iso('created_at')} AS current_period_end, mrr_cents, currency, {iso('created_at')} AS created_at,
  {iso('canceled_at')} AS canceled_at FROM subs""")
oracle("sink_events_json", f"""
SELECT tenant_id, event_id, event_type, {iso('"timestamp"')} AS "timestamp", customer_id, amount_cents, ingest_seq
FROM billing""")

# -- ingest ------------------------------------------------------------------------
PARTS["faulty"] = """
SELECT *, CAST(regexp_extract(event_id, '(\\d+)', 1) AS BIGINT) % 101 AS fault FROM billing"""
PARTS["judged"] = """
SELECT *, CASE fault
  WHEN 1 THEN 'Event must be an object'
  WHEN 2 THEN 'event_id: required, event_type: required, timestamp: required, customer_id: required, raw_payload: expected object'
  WHEN 3 THEN 'customer_id: required'
  WHEN 4 THEN 'event_id: too short'
  WHEN 5 THEN 'event_type: not in enumeration'
  WHEN 6 THEN 'timestamp: invalid format'
  WHEN 7 THEN 'amount_cents: not an integer'
  WHEN 9 THEN 'currency: invalid format'
  WHEN 10 THEN 'subscription_id: expected string'
  WHEN 13 THEN 'customer_id: required, currency: invalid format' END AS error
FROM faulty"""
PARTS["accepted"] = """
SELECT * REPLACE (CASE WHEN fault = 8 THEN 5000 ELSE amount_cents END AS amount_cents) FROM judged WHERE error IS NULL"""
_RAW_BACK = """
SELECT event_id, event_type, customer_id, currency, amount_cents, CAST(NULL AS VARCHAR) AS error FROM accepted
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, error FROM judged WHERE error IS NOT NULL"""
oracle("src_raw_lines", _RAW_BACK)
oracle("src_raw_array", _RAW_BACK + """
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, unnest(['Input file must be valid JSON', 'Input file must be an array'])""")
HASHED = """sha256('{' || concat_ws(',',
  '"tenant_id":"' || tenant_id || '"', '"project_id":"' || project_id || '"', '"event_id":"' || event_id || '"',
  '"event_type":"' || event_type || '"', '"timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') || '"',
  '"customer_id":"' || customer_id || '"', '"subscription_id":"' || subscription_id || '"',
  '"invoice_id":"' || invoice_id || '"', '"amount_cents":' || amount_cents, '"currency":"' || currency || '"',
  '"plan_id":"' || plan_id || '"') || '}')"""
oracle("ingest_events", f"""
SELECT {SCOPE}, event_id, event_type, {iso('"timestamp"')} AS "timestamp", {iso('"timestamp"')} AS timestamp_text,
  customer_id, subscription_id, invoice_id, amount_cents, currency, plan_id, {HASHED} AS source_hash, ingest_seq,
  '{{}}' AS metadata_json
FROM accepted""")
oracle("ingest_events_lenient", f"""
SELECT {SCOPE}, CASE fault WHEN 2 THEN NULL WHEN 4 THEN '' ELSE event_id END AS event_id,
  CASE fault WHEN 2 THEN NULL WHEN 5 THEN 'foo' ELSE event_type END AS event_type,
  CASE WHEN fault IN (2, 3, 13) THEN NULL ELSE customer_id END AS customer_id,
  CASE WHEN fault = 2 THEN NULL WHEN fault IN (9, 13) THEN 'usd' ELSE currency END AS currency, ingest_seq,
  replace(coalesce(error, ''), ', ', ' | ') AS validation_errors
FROM judged WHERE fault <> 1""")
oracle("ingest_errors", f"SELECT {SCOPE}, ingest_seq, error FROM judged WHERE error IS NOT NULL")
oracle("ingest_errors_sample", f"""
SELECT {SCOPE}, ingest_seq, error, position FROM (
  SELECT *, (SELECT count(*) FROM judged o WHERE o.error IS NOT NULL AND o.tenant_id = j.tenant_id
             AND o.ingest_seq <= j.ingest_seq) AS position
  FROM judged j WHERE error IS NOT NULL) WHERE position <= 20""")
oracle("ingest_stats", f"""
SELECT {SCOPE}, count(*) AS total, count(*) - count(error) AS valid, count(error) AS invalid FROM judged GROUP BY ALL""")
oracle("ingest_stats_by_type", f"SELECT {SCOPE}, event_type, count(*) AS event_count FROM accepted GROUP BY ALL")
oracle("event_source_hash", f"SELECT {SCOPE}, event_id, ingest_seq, {HASHED} AS source_hash FROM billing")

# -- contract sweep -------------------------------------------------------------------
PARTS["shifted_billing"] = "SELECT * REPLACE (amount_cents - 6000 AS amount_cents) FROM numbered"
from oracles.parts import ledger_parts  # noqa: E402

ledger_parts("sh_", PERIOD_A, PERIOD_B, "shifted_billing")


def _below(table: str, source: str, key: str, column: str) -> str:
    return f"""SELECT {SCOPE}, '{table}' AS table_name, {key} AS row_key, '{column}: below 0' AS violation
FROM {source} WHERE {column} < 0"""


oracle("contract_violations", "\nUNION ALL ".join(
    [_below("ledger_subscriptions", "sh_subs", "subscription_id || '#' || generation", "mrr_cents")]
    + [_below("ledger_customers", "sh_cust", "customer_id", col) for col in (
        "total_mrr_cents", "total_paid_cents", "total_refunded_cents", "total_disputed_cents")]
    + [_below("ledger_totals", "sh_totals", "'total'", "total_mrr_cents")]))

# -- ledger ---------------------------------------------------------------------------
oracle("ledger_period_events", f"""
SELECT {SCOPE}, event_id, event_type, {iso('"timestamp"')} AS "timestamp", ingest_seq FROM period""")
oracle("ledger_subscriptions", f"""
SELECT {SCOPE}, subscription_id, generation, customer_id, plan_id, status, {iso('created_at')} AS current_period_start,
  {iso('created_at')} AS current_period_end, mrr_cents, currency, {iso('created_at')} AS created_at,
  {iso('canceled_at')} AS canceled_at, false AS cancel_at_period_end FROM subs""")
oracle("ledger_customers", f"""
SELECT * REPLACE ({iso('last_invoice_at')} AS last_invoice_at, {iso('last_payment_at')} AS last_payment_at,
  {iso('updated_at')} AS updated_at) FROM plain""")
oracle("ledger_customer_mrr", f"""
SELECT {SCOPE}, customer_id, total_mrr_cents, active_subscriptions, subscription_count FROM cust""")
oracle("ledger_totals", "SELECT * FROM totals")
ORACLES["ledger_kept_subscriptions"] = ORACLES["ledger_subscriptions"]
ORACLES["ledger_kept_totals"] = ORACLES["ledger_totals"]

DIGEST = """sha256(CAST(count(*) AS VARCHAR) || ':' || concat_ws(':', {parts}))""".format(parts=", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)))
NO_DIGEST = "sha256('0:0:0:0:0:0:0:0:0')"

# -- reconciliation -----------------------------------------------------------------------
REPORT_NAME = f"'recon-' || t.tenant_id || '-' || t.project_id || '-{PERIOD_A}-{PERIOD_B}'"
oracle("recon_discrepancies", "SELECT * FROM disc")
PARTS["unpaid"] = "SELECT * FROM plain WHERE payment_failure_count_30d > 0 AND last_payment_at IS NULL"
oracle("recon_missing_events", f"""
SELECT {SCOPE}, 'missing-payment-' || customer_id AS event_id, 'payment_succeeded' AS event_type,
  {iso(ts(PERIOD_B))} AS "timestamp", customer_id,
  'Expected payment based on subscription but none found' AS note, payment_failure_count_30d AS failure_count
FROM unpaid""")
PARTS["period_totals"] = """
SELECT tenant_id, project_id, CAST(sum(total_mrr_cents) AS BIGINT) AS mrr, CAST(sum(total_paid_cents) AS BIGINT) AS paid
FROM cust GROUP BY ALL"""
oracle("recon_summary", f"""
SELECT {SCOPE}, {REPORT_NAME} AS report_id, '{PERIOD_A}' AS period_start, '{PERIOD_B}' AS period_end,
  mrr AS total_expected_mrr_cents, paid AS total_observed_mrr_cents, mrr - paid AS total_difference_cents,
  (SELECT count(*) FROM disc d WHERE d.tenant_id = t.tenant_id) AS discrepancy_count,
  (SELECT count(*) FROM unpaid u WHERE u.tenant_id = t.tenant_id) AS missing_event_count,
  mrr = paid AND NOT EXISTS (SELECT 1 FROM disc d WHERE d.tenant_id = t.tenant_id) AS is_balanced
FROM period_totals t""")
PARTS["disc_hashes"] = """
SELECT *, sha256('{"subscription_id":"' || subscription_id || '","difference_cents":' || difference_cents
  || ',"reason":"' || reason || '"}') AS h FROM disc"""
oracle("recon_report_hash", f"""
SELECT {SCOPE}, {REPORT_NAME} AS report_id, discrepancy_count,
  sha256(concat_ws('|', tenant_id, project_id, '{PERIOD_A}', '{PERIOD_B}', coalesce(digest, {NO_DIGEST}))) AS report_hash
FROM (SELECT t.*, coalesce(n, 0) AS discrepancy_count, digest FROM period_totals t LEFT JOIN (
  SELECT {SCOPE}, count(*) AS n, {DIGEST} AS digest FROM disc_hashes GROUP BY ALL) d USING (tenant_id, project_id)) t""")


def tree_hash(leaves: str) -> str:
    """(tenant, tree_hash) of leaves (tenant, place, h): four levels of 1024 neighbours."""
    for _ in range(4):
        leaves = f"""SELECT {SCOPE}, place // 1024 AS place, sha256(string_agg(h, '' ORDER BY place)) AS h
FROM ({leaves}) GROUP BY {SCOPE}, place // 1024"""
    return f"SELECT {SCOPE}, h AS tree_hash FROM ({leaves})"


oracle("recon_tree_hash", f"""
SELECT {SCOPE}, {REPORT_NAME} AS report_id, sha256(concat_ws('|', tenant_id, project_id, '{PERIOD_A}', '{PERIOD_B}',
  coalesce(tree_hash, sha256('')))) AS report_tree_hash
FROM period_totals t LEFT JOIN (""" + tree_hash("""
  SELECT tenant_id, project_id, h, row_number() OVER (PARTITION BY tenant_id, project_id
    ORDER BY customer_id, subscription_id, generation, difference_cents, reason) - 1 AS place
  FROM disc_hashes""") + """) d USING (tenant_id, project_id)""")

# -- anomalies --------------------------------------------------------------------------
oracle("anomaly_duplicate_event", fd.ANOMALY["duplicate_event"])
oracle("anomaly_missing_invoice", fd.ANOMALY["missing_invoice"])
oracle("anomaly_double_charge", fd.ANOMALY["double_charge"])
oracle("anomaly_refund_spike", fd.ANOMALY["refund_spike"])
oracle("anomaly_dispute_spike", fd.ANOMALY["dispute_spike"])
oracle("anomaly_payment_failure_spike", fd.ANOMALY["payment_failure_spike"])
oracle("anomaly_payment_failure_strict", fd.anomaly_sql(fd.BASE | {"failure": 0.7})["payment_failure_spike"])
oracle("anomaly_cancel_before_create", fd.ANOMALY["cancel_before_create"])
oracle("anomaly_payment_after_cancel", fd.ANOMALY["payment_after_cancel"])
oracle("anomalies_all", "SELECT * FROM anomalies")
TENANT_PROFILES = {
    "tenant-0": {"refund_cents": 25000, "window": 60},
    "tenant-1": {"failure": 0.15, "window": 180},
    "tenant-2": {"refund_pct": 5.0},
}
oracle("anomalies_by_profile", "\nUNION ALL ".join(
    f"SELECT * FROM ({fd.anomaly_sql(fd.BASE | own)[kind]}) WHERE tenant_id = '{tenant}'"
    for tenant, own in TENANT_PROFILES.items()
    for kind in ("duplicate_event", "refund_spike", "payment_failure_spike")))
oracle("anomaly_stats_by_type", f"""
SELECT t.tenant_id, t.project_id, k.anomaly_type, count(a.anomaly_id) AS anomaly_count
FROM totals t CROSS JOIN (SELECT unnest(['missing_invoice', 'double_charge', 'refund_spike', 'dispute_spike',
  'payment_failure_spike', 'usage_drop', 'mrr_discrepancy', 'duplicate_event', 'out_of_sequence']) AS anomaly_type) k
LEFT JOIN anomalies a ON a.tenant_id = t.tenant_id AND a.anomaly_type = k.anomaly_type GROUP BY ALL""")
oracle("anomaly_stats_by_severity", f"""
SELECT t.tenant_id, t.project_id, k.severity, count(a.anomaly_id) AS anomaly_count
FROM totals t CROSS JOIN (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity) k
LEFT JOIN anomalies a ON a.tenant_id = t.tenant_id AND a.severity = k.severity GROUP BY ALL""")
oracle("anomaly_events", """
SELECT tenant_id, project_id, anomaly_id, reference AS event_id FROM anomalies WHERE anomaly_type = 'duplicate_event'
UNION ALL
SELECT tenant_id, project_id, anomaly_id, reference FROM anomalies
WHERE anomaly_type IN ('duplicate_event', 'out_of_sequence')
UNION ALL
SELECT b.tenant_id, b.project_id, a.anomaly_id, b.event_id FROM billing b JOIN (SELECT DISTINCT tenant_id, anomaly_id,
  reference FROM anomalies WHERE anomaly_type = 'missing_invoice') a
ON a.tenant_id = b.tenant_id AND a.reference = b.subscription_id
UNION ALL
SELECT b.tenant_id, b.project_id, a.anomaly_id, b.event_id FROM paid_invoices b JOIN anomalies a
ON a.anomaly_type = 'double_charge' AND a.tenant_id = b.tenant_id AND a.reference = b.invoice_id
UNION ALL
SELECT b.tenant_id, b.project_id, a.anomaly_id, b.event_id FROM billing b JOIN anomalies a
ON a.tenant_id = b.tenant_id AND (
  (a.anomaly_type = 'refund_spike' AND b.event_type IN ('invoice_refunded', 'refund_issued')) OR
  (a.anomaly_type = 'dispute_spike' AND b.event_type IN ('invoice_disputed', 'dispute_created', 'dispute_lost')))""")

# -- churn ----------------------------------------------------------------------------------
SIGNAL = f"SELECT {SCOPE}, customer_id, '{{name}}' AS signal_type, {{w}} AS weight, {{evidence}} AS evidence FROM weights WHERE {{w}} IS NOT NULL"
oracle("churn_signal_payment", SIGNAL.format(
    name="payment_failures", w="w1",
    evidence="f || ' payment failure(s) in last 30 days | Payment failures correlate with involuntary churn risk'"))
oracle("churn_signal_usage", SIGNAL.format(
    name="usage_drop", w="w2",
    evidence="""'Usage metric "' || metric_name || '" dropped ' || printf('%.1f', pct) || '% | From '
      || printf('%.2f', prev) || ' to ' || printf('%.2f', cur) || ' | Usage drops often precede voluntary churn'"""))
oracle("churn_signal_tickets", SIGNAL.format(
    name="support_tickets", w="w3",
    evidence="""n_tick || ' support ticket(s), ' || n_open || ' open'
      || CASE WHEN n_crit > 0 THEN ' | ' || n_crit || ' critical severity' ELSE '' END
      || ' | Support friction correlates with churn intent'"""))
oracle("churn_signal_downgrade", SIGNAL.format(
    name="plan_downgrade", w="w4",
    evidence="""n_down || ' plan downgrade(s) recorded | ' || CASE WHEN n_recent > 0
      THEN n_recent || ' downgrade(s) in last 30 days' ELSE 'Most recent downgrade >30 days ago' END
      || ' | Downgrades often precede full cancellation'"""))
oracle("churn_signal_inactivity", SIGNAL.format(
    name="no_recent_login", w="w5",
    evidence="""CASE WHEN idle IS NULL THEN 'No recorded payment activity'
      ELSE 'No payment in ' || CAST(floor(idle + 0.5) AS BIGINT) || ' days' END
      || ' | Inactivity indicates potential disengagement'"""))
oracle("churn_risk_score", "SELECT * EXCLUDE (explanation, acts) FROM risks")
oracle("churn_by_tenant_date", "SELECT * EXCLUDE (explanation, acts) FROM d_risks")
oracle("churn_explanations", f"SELECT {SCOPE}, customer_id, explanation FROM risks")
oracle("churn_recommendations", f"SELECT {SCOPE}, customer_id, recommended_actions FROM advised")
oracle("churn_ranked", f"""
SELECT {SCOPE}, customer_id, risk_id, risk_score, risk_level,
  row_number() OVER (PARTITION BY tenant_id ORDER BY risk_score DESC, customer_id) AS risk_rank FROM risks""")
oracle("churn_stats", f"""
SELECT {SCOPE}, count(*) AS total_assessed, count(*) FILTER (WHERE risk_level = 'low') AS low_count,
  count(*) FILTER (WHERE risk_level = 'medium') AS medium_count, count(*) FILTER (WHERE risk_level = 'high') AS high_count,
  count(*) FILTER (WHERE risk_level = 'critical') AS critical_count, avg(risk_score) AS average_score
FROM risks GROUP BY ALL""")

# -- cost -------------------------------------------------------------------------------------
PARTS["items"] = """
SELECT tenant_id, project_id, event_id, CASE
    WHEN event_type IN ('subscription_created', 'subscription_updated', 'invoice_paid') THEN 'subscription'
    WHEN event_type IN ('invoice_refunded', 'refund_issued') THEN 'refund'
    WHEN event_type IN ('invoice_disputed', 'dispute_created') THEN 'dispute'
    WHEN event_type = 'usage_recorded' THEN 'usage' ELSE 'other' END AS category,
  customer_id, subscription_id, coalesce(amount_cents, 0) AS amount_cents,
  CASE event_type
    WHEN 'subscription_created' THEN 'Subscription ' || subscription_id || ' - ' || coalesce(plan_id, 'unknown')
    WHEN 'subscription_updated' THEN 'Subscription ' || subscription_id || ' - ' || coalesce(plan_id, 'unknown')
    WHEN 'invoice_paid' THEN 'Invoice payment ' || coalesce(invoice_id, 'unknown')
    WHEN 'invoice_refunded' THEN 'Refund ' || coalesce(invoice_id, 'unknown') || ' - ' || coalesce(amount_cents, 0) || ' cents'
    WHEN 'refund_issued' THEN 'Refund ' || coalesce(invoice_id, 'unknown') || ' - ' || coalesce(amount_cents, 0) || ' cents'
    WHEN 'invoice_disputed' THEN 'Dispute ' || coalesce(invoice_id, 'unknown')
    WHEN 'dispute_created' THEN 'Dispute ' || coalesce(invoice_id, 'unknown')
    WHEN 'usage_recorded' THEN 'Usage record ' || customer_id
    ELSE 'Event ' || event_type END AS description
FROM billing"""
PARTS["asked"] = f"""
SELECT DISTINCT 'tenant-' || (user_id % 5) AS tenant_id, 'project-main' AS project_id, p.a AS period_start, p.b AS period_end
FROM events, (VALUES ('{PERIOD_A}', '{PERIOD_B}'), ('{PERIOD_B}', '{PERIOD_A}')) p(a, b)"""
PARTS["answered"] = """
SELECT a.*, CASE
  WHEN tenant_id = 'tenant-4' THEN 'INSUFFICIENT_EVENTS: At least one billing event required'
  WHEN NOT EXISTS (SELECT 1 FROM billing b WHERE b.tenant_id = a.tenant_id)
    THEN 'INSUFFICIENT_DATA: No billing events or ledger provided'
  WHEN (SELECT count(DISTINCT currency) FROM billing b WHERE b.tenant_id = a.tenant_id) > 1
    THEN 'CURRENCY_MISMATCH: Multiple currencies detected'
  WHEN CAST(rtrim(period_start, 'Z') AS TIMESTAMP) >= CAST(rtrim(period_end, 'Z') AS TIMESTAMP)
    THEN 'INVALID_PERIOD: period_start must be before period_end' END AS refusal
FROM asked a"""
oracle("cost_from_ledger", f"""
SELECT {SCOPE}, 'derived_' || subscription_id AS event_id, 'subscription' AS category, customer_id, subscription_id,
  mrr_cents AS amount_cents, 'Subscription ' || subscription_id || ' - ' || plan_id AS description FROM subs""")
oracle("cost_line_items", """
SELECT i.*, a.period_start, a.period_end, 'USD' AS currency FROM items i JOIN answered a USING (tenant_id, project_id)
WHERE a.refusal IS NULL""")
oracle("cost_by_category", f"""
SELECT t.tenant_id, t.project_id, k.category, CAST(coalesce(sum(i.amount_cents), 0) AS BIGINT) AS amount_cents
FROM (SELECT DISTINCT {SCOPE} FROM billing) t
CROSS JOIN (SELECT unnest(['subscription', 'usage', 'refund', 'dispute', 'other']) AS category) k
LEFT JOIN items i ON i.tenant_id = t.tenant_id AND i.category = k.category GROUP BY ALL""")
oracle("cost_by_customer", f"""
SELECT {SCOPE}, customer_id, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM items GROUP BY ALL""")
oracle("cost_by_subscription", f"""
SELECT {SCOPE}, subscription_id, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM items
WHERE subscription_id IS NOT NULL GROUP BY ALL""")
oracle("cost_snapshot", """
SELECT a.tenant_id, a.project_id, a.period_start, a.period_end,
  'cost-snapshot-' || substr(sha256('{"period_end":"' || a.period_end || '","period_start":"' || a.period_start
    || '","project_id":"' || a.project_id || '","tenant_id":"' || a.tenant_id || '"}'), 1, 16) AS report_id,
  CAST(sum(coalesce(b.amount_cents, 0)) AS BIGINT) AS total_cost_cents, min(b.currency) AS currency,
  count(*) AS event_count, count(DISTINCT b.customer_id) AS customer_count,
  count(DISTINCT b.subscription_id) AS subscription_count, true AS cached
FROM answered a JOIN billing b USING (tenant_id, project_id) WHERE a.refusal IS NULL GROUP BY ALL""")
oracle("cost_refusals", "SELECT * FROM answered WHERE refusal IS NOT NULL")
PARTS["row_hashes"] = f"SELECT {SCOPE}, {HASHED} AS h FROM billing"
oracle("cost_cache_key", f"""
SELECT a.tenant_id, a.project_id, a.period_start, a.period_end,
  sha256('{{"capability":"finops.cost_snapshot","input_hash":"' || d.input_hash || '","period_end":"' || a.period_end
    || '","period_start":"' || a.period_start || '","project_id":"' || a.project_id || '","tenant_id":"' || a.tenant_id
    || '"}}') AS cache_key
FROM answered a JOIN (SELECT {SCOPE}, {DIGEST} AS input_hash FROM row_hashes GROUP BY ALL) d USING (tenant_id, project_id)
WHERE a.refusal IS NULL""")
oracle("cost_incremental", f"""
SELECT DISTINCT {SCOPE}, strftime("timestamp", '%Y-%m-%d') || 'T00:00:00.000Z' AS period_start,
  strftime("timestamp", '%Y-%m-%d') || 'T23:59:59.999Z' AS period_end
FROM billing WHERE "timestamp" >= TIMESTAMP '2024-01-20'""")
oracle("cost_stored_snapshots", f"""
SELECT DISTINCT {SCOPE}, strftime("timestamp", '%Y-%m-%d') || 'T00:00:00.000Z' AS period_start,
  strftime("timestamp", '%Y-%m-%d') || 'T23:59:59.999Z' AS period_end,
  CASE WHEN "timestamp" < TIMESTAMP '2024-01-20' THEN 'run-1' ELSE 'run-2' END AS stored_by
FROM billing""")

PARTS["finding_hashes"] = """
SELECT *, sha256('{"category":"' || category || '","description":' || to_json(description) || ',"evidence":' || to_json(evidence)
  || ',"finding_id":"' || finding_id || '","metadata":{},"severity":"' || severity || '","title":"' || title || '"}') AS h FROM found"""
PARTS["hashed_reports"] = f"""
SELECT j.*, sha256(head || '|' || coalesce(digest, {NO_DIGEST})) AS canonical_hash
FROM documents_json j LEFT JOIN (SELECT {SCOPE}, {DIGEST} AS digest FROM finding_hashes GROUP BY ALL) USING (tenant_id, project_id)"""

PARTS["placed_hashes"] = PARTS["finding_hashes"].replace("FROM found", "FROM placed")
oracle("report_tree_hash", f"""
SELECT {SCOPE}, report_id, sha256(head || '|' || coalesce(tree_hash, sha256(''))) AS report_tree_hash
FROM documents_json LEFT JOIN (""" + tree_hash(
    f"SELECT {SCOPE}, h, finding_rank - 1 AS place FROM placed_hashes") + """) d USING (tenant_id, project_id)""")

# -- findings and report ------------------------------------------------------------------------
oracle("report_period", f"""
SELECT t.tenant_id, t.project_id,
  coalesce({iso('min(b."timestamp")')}, '2024-01-01T00:00:00.000Z') AS period_start,
  coalesce({iso('max(b."timestamp")')}, '2024-01-31T23:59:59.999Z') AS period_end
FROM (SELECT DISTINCT {SCOPE} FROM asked) t LEFT JOIN billing b USING (tenant_id, project_id) GROUP BY ALL""")
oracle("findings", """
SELECT * EXCLUDE (tie, evidence), array_to_string(evidence, ' | ') AS evidence FROM found""")
oracle("findings_ranked", f"SELECT {SCOPE}, finding_id, severity, category, finding_rank FROM placed")
oracle("findings_by_period", f"SELECT {SCOPE}, finding_id, title, description, severity, category, finding_rank FROM o_placed")
oracle("anomalies_by_period", "SELECT * FROM o_r_anomalies")
oracle("report_summary_by_period", "SELECT * FROM o_summed")
oracle("recon_summary_by_period", "SELECT * FROM o_reconciled")
oracle("ledger_subscriptions_by_period", f"""
SELECT {SCOPE}, subscription_id, generation, customer_id, plan_id, status, mrr_cents, currency,
  {iso('created_at')} AS created_at, {iso('canceled_at')} AS canceled_at FROM o_subs""")
oracle("recommendations", "SELECT * FROM advice")
oracle("report_summary", "SELECT * FROM summed")
oracle("report_envelope", f"""
SELECT {SCOPE}, trace_id, report_id, '1970-01-01T00:00:00.000Z' AS generated_at, finding_count, canonical_hash FROM hashed_reports""")
_HEAD = [
    "'# Billing Report'", "''", "'- Tenant: ' || tenant_id", "'- Project: ' || project_id", "'- Trace: ' || trace_id",
    "'- Generated: 1970-01-01T00:00:00.000Z'", "''", "'## Summary'", "''",
    "'- Period: ' || period_start || ' to ' || period_end", "'- Events: ' || event_count",
    "'- Normalized events: ' || normalized_event_count", "'- Customers: ' || ledger_customer_count",
    "'- MRR (cents): ' || ledger_mrr_cents", "'- Reconciliation discrepancies: ' || reconciliation_discrepancies",
    "'- Anomalies: ' || anomaly_count", "'- Churn risks: ' || churn_risk_count",
    "'- Job requests: ' || job_request_count", "''", "'## Findings'", "''"]
_FINDING = ["'- [' || upper(p.severity) || '] ' || p.title", "'  - ' || p.description",
            "'  - Evidence: ' || array_to_string(p.evidence, '; ')"]
_TAIL = ["''", "'## Canonicalization'", "''", "'- Algorithm: sha256'", "'- Format: json-stable'",
         "'- Hash: ' || canonical_hash"]
oracle("report_markdown_lines", f"""
SELECT {SCOPE}, row_number() OVER (PARTITION BY tenant_id ORDER BY a, b, c) AS line_no, line FROM (
  SELECT {SCOPE}, 1 AS a, 0 AS b, generate_subscripts(lines, 1) AS c, unnest(lines) AS line
  FROM (SELECT *, [{', '.join(_HEAD)}] AS lines FROM hashed_reports)
  UNION ALL
  SELECT {SCOPE}, 2, finding_rank, generate_subscripts(lines, 1), unnest(lines)
  FROM (SELECT *, [{', '.join(_FINDING)}] AS lines FROM placed p)
  UNION ALL
  SELECT {SCOPE}, 3, 0, generate_subscripts(lines, 1), unnest(lines)
  FROM (SELECT *, ['', '## Recommendations', ''] AS lines FROM hashed_reports)
  UNION ALL
  SELECT {SCOPE}, 4, row_number() OVER (PARTITION BY tenant_id ORDER BY recommendation), 0, '- ' || recommendation FROM advice
  UNION ALL
  SELECT {SCOPE}, 5, 0, generate_subscripts(lines, 1), unnest(lines)
  FROM (SELECT *, [{', '.join(_TAIL)}] AS lines FROM hashed_reports))""")
PARTS["mailed"] = """
SELECT *, CASE WHEN event_id % 3 = 0 THEN 'user' || user_id || '@example.com' ELSE 'nobody' END AS who FROM events"""
PARTS["canon"] = """
SELECT event_id, '{"API_KEY":"' || user_id || '","event":' || event_id || ',"nested":{"kind":"' || event_type
  || '","list":["plain","' || who || '"],"userPassword":{"deep":1}},"tokens":[' || user_id || ']}' AS canonical
FROM mailed"""
oracle("canonical_hash", "SELECT event_id, canonical, sha256(canonical) AS canonical_hash FROM canon")

# -- work queue -----------------------------------------------------------------------------------
PARTS["renter"] = """
SELECT 'cust-' || c_custkey AS tenant_id, 'nation-' || c_nationkey AS project_id, 'trace-' || c_custkey AS trace_id,
  c_custkey AS number,
  './input/events-' || c_custkey || '.json' AS events_path, './input/ledger-' || c_custkey || '.json' AS ledger_path,
  CASE WHEN c_custkey % 2 = 0 THEN './input/usage-' || c_custkey || '.json' END AS usage_path,
  CASE WHEN c_custkey % 3 = 0 THEN './input/tickets-' || c_custkey || '.json' END AS tickets_path
FROM customer"""
_FILE = """'{{"format":"json","path":"' || {p} || '","type":"file"}}'"""
PARTS["work"] = f"""
SELECT *, 'autopilot.finops.anomaly_scan' AS job_type, 300 AS timeout_seconds,
  '{{"ledger_source":' || {_FILE.format(p='ledger_path')} || ',"operation":"anomaly_scan","output":{{"anomalies_path":"./output/anomalies-'
  || tenant_id || '-' || project_id || '.json"}}}}' AS payload
FROM renter WHERE number % 4 <> 2
UNION ALL
SELECT *, 'autopilot.finops.churn_risk_report', 600,
  '{{"inputs":{{"ledger":' || {_FILE.format(p='ledger_path')}
  || coalesce(',"support_tickets":' || {_FILE.format(p='tickets_path')}, '')
  || coalesce(',"usage_metrics":' || {_FILE.format(p='usage_path')}, '')
  || '}},"operation":"churn_risk_report","output":{{"report_path":"./output/churn-' || tenant_id || '-' || project_id || '.json"}}}}'
FROM renter WHERE number % 4 <> 3
UNION ALL
SELECT *, 'autopilot.finops.reconcile', 300,
  '{{"events_source":' || {_FILE.format(p='events_path')} || ',"operation":"reconcile","output":{{"ledger_path":"./output/ledger-'
  || tenant_id || '-' || project_id || '.json","report_path":"./output/recon-' || tenant_id || '-' || project_id
  || '.json"}},"period_end":"{PERIOD_B}","period_start":"{PERIOD_A}"}}'
FROM renter WHERE number % 4 <> 1"""
PARTS["queue"] = """
SELECT *, 'job-' || substr(idempotency_key, 1, 16) AS job_id,
  '{"finops_hooks":{"capability":"' || job_type || '","cost_context":{"cost_center":"' || tenant_id || ':' || project_id
  || '","tags":["finops","' || job_type || '"]},"module_id":"finops","project_id":"' || project_id || '","tenant_id":"'
  || tenant_id || '"},"job_type_status":"AVAILABLE","jobforge_dry_run":true,"module_id":"finops",'
  || '"requires_policy_token":false,"trace_id":"' || trace_id || '"}' AS metadata
FROM (SELECT *, sha256('{"job_type":"' || job_type || '","payload":' || payload || ',"project_id":"' || project_id
  || '","tenant_id":"' || tenant_id || '"}') AS idempotency_key FROM work)"""
oracle("job_requests", f"""
SELECT {SCOPE}, trace_id, job_type, job_id, '1970-01-01T00:00:00.000Z' AS requested_at, payload, 'normal' AS priority,
  3 AS max_retries, timeout_seconds, metadata, idempotency_key FROM queue""")
_HOOKS = """'"finops_hooks":{{"capability":"{cap}","cost_context":{{"cost_center":"' || tenant_id || ':' || project_id
  || '","tags":["finops","{cap}"]}},"module_id":"finops","project_id":"' || project_id || '","tenant_id":"' || tenant_id || '"}}'"""
_PATHS = """'./output/{kind}-' || tenant_id || '-' || project_id || '.json"'"""
PARTS["alone"] = f"""
SELECT *, 'autopilot.finops.anomaly_scan' AS job_type,
  '{{' || {_HOOKS.format(cap='anomaly_detect')} || ',"ledger_path":"' || ledger_path || '","ledger_source":'
  || {_FILE.format(p='ledger_path')} || ',"max_retries":3,"operation":"anomaly_scan","output":{{"anomalies_path":"'
  || {_PATHS.format(kind='anomalies')} || '}},"thresholds":{{"dispute_spike_threshold":5,'
  || '"payment_failure_spike_threshold":0.25,"refund_spike_threshold_cents":100000}},"timeout_seconds":300}}' AS payload,
  '{{"triggered_by":"tallyline"}}' AS metadata
FROM renter WHERE number % 4 <> 2
UNION ALL
SELECT *, 'autopilot.finops.churn_risk_report',
  '{{' || {_HOOKS.format(cap='churn_assess')} || ',"inputs":{{"ledger":' || {_FILE.format(p='ledger_path')}
  || coalesce(',"support_tickets":' || {_FILE.format(p='tickets_path')}, '')
  || coalesce(',"usage_metrics":' || {_FILE.format(p='usage_path')}, '')
  || '}},"max_retries":3,"operation":"churn_risk_report","output":{{"report_path":"' || {_PATHS.format(kind='churn')}
  || '}},"timeout_seconds":600,"weights":{{"inactivity":0.1,"payment_failure":0.3,"plan_downgrade":0.15,'
  || '"support_tickets":0.2,"usage_drop":0.25}}}}',
  '{{"notes":"Operational insights only - not financial advice","triggered_by":"tallyline"}}'
FROM renter WHERE number % 4 <> 3
UNION ALL
SELECT *, 'autopilot.finops.reconcile',
  '{{"events_source":' || {_FILE.format(p='events_path')} || ',' || {_HOOKS.format(cap='mrr_reconcile')}
  || ',"max_retries":3,"operation":"reconcile","output":{{"ledger_path":"' || {_PATHS.format(kind='ledger')}
  || ',"report_path":"' || {_PATHS.format(kind='recon')} || '}},"period_end":"{PERIOD_B}","period_start":"{PERIOD_A}","timeout_seconds":300}}',
  '{{"notes":"Events source: ' || events_path || '","triggered_by":"tallyline"}}'
FROM renter WHERE number % 4 <> 1"""
oracle("job_standalone_requests", f"""
SELECT {SCOPE}, job_type, 'job-' || substr(sha256(job_type || ':' || tenant_id || ':' || project_id || ':' || payload), 1, 16)
  AS job_id, '1970-01-01T00:00:00.000Z' AS requested_at, payload, 'normal' AS priority, 3 AS max_retries,
  300 AS timeout_seconds, metadata FROM alone""")
oracle("job_bundles", f"""
SELECT {SCOPE}, trace_id, count(*) AS job_count,
  sha256('{{"metadata":{{"job_count":' || count(*) || '}},"module_id":"finops","project_id":"' || project_id
  || '","requests":[' || string_agg('{{"idempotency_key":"' || idempotency_key || '","job_id":"' || job_id
     || '","job_type":"' || job_type || '","max_retries":3,"metadata":' || metadata || ',"payload":' || payload
     || ',"priority":"normal","project_id":"' || project_id || '","requested_at":"1970-01-01T00:00:00.000Z","tenant_id":"'
     || tenant_id || '","timeout_seconds":' || timeout_seconds || '}}', ',' ORDER BY job_type)
  || '],"schema_version":"1.0.0","tenant_id":"' || tenant_id || '","trace_id":"' || trace_id || '"}}') AS canonical_hash
FROM queue GROUP BY {SCOPE}, trace_id""")
oracle("job_priority_ids", """
SELECT tenant_id, project_id, 'priority_anomaly_ids' AS list, anomaly_id AS id FROM anomalies WHERE severity = 'critical'
UNION ALL
SELECT tenant_id, project_id, 'priority_customer_ids', customer_id FROM risks WHERE risk_level = 'critical'""")
oracle("job_request_violations", """
SELECT 'bundle-' || job_id AS bundle_id, job_id, CASE number % 8
  WHEN 1 THEN 'tenant_id: required' WHEN 2 THEN 'project_id: required' WHEN 3 THEN 'bundle.schema_version: unsupported'
  WHEN 4 THEN 'idempotency_key: required' WHEN 5 THEN 'payload: action without policy token'
  WHEN 6 THEN 'tenant_id: differs from bundle' ELSE 'job_type: unknown without UNAVAILABLE status' END AS violation
FROM queue WHERE number % 8 <> 0""")
oracle("job_request_dedupe", f"""
SELECT {SCOPE}, job_type, job_id, '1970-01-01T00:00:00.000Z' AS requested_at, idempotency_key,
  CASE WHEN number % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS copies
FROM queue WHERE number % 7 <> 0""")
oracle("job_requests_done", f"""
SELECT {SCOPE}, job_type, idempotency_key, CAST(1 AS BIGINT) AS copies,
  CASE WHEN number % 7 = 0 THEN 'run-1' ELSE 'run-2' END AS done_by
FROM queue""")

# -- profiles -----------------------------------------------------------------------------------------
_FIELDS = ["refund_spike_threshold_cents", "refund_spike_threshold_pct", "dispute_spike_threshold",
           "payment_failure_spike_threshold", "duplicate_event_window_seconds", "usage_drop_threshold_pct",
           "payment_failure_weight", "usage_drop_weight", "support_ticket_weight", "plan_downgrade_weight",
           "inactivity_weight", "risk_score_low_threshold", "risk_score_medium_threshold", "risk_score_high_threshold"]
_SHIPPED = [
    ("base", 100000, 10, 5, 0.25, 300, 50, 0.3, 0.25, 0.2, 0.15, 0.1, 30, 50, 75),
    ("jobforge", 50000, 10, 5, 0.2, 300, 50, 0.35, 0.3, 0.2, 0.15, 0.1, 30, 50, 75),
    ("settler", 25000, 10, 3, 0.25, 60, 50, 0.4, 0.25, 0.2, 0.15, 0.1, 30, 50, 70),
    ("readylayer", 100000, 5, 5, 0.25, 300, 30, 0.3, 0.35, 0.25, 0.15, 0.1, 30, 50, 75),
    ("aias", 75000, 10, 5, 0.25, 300, 40, 0.3, 0.4, 0.2, 0.15, 0.15, 30, 50, 75),
    ("keys", 100000, 10, 5, 0.15, 180, 50, 0.25, 0.25, 0.3, 0.15, 0.1, 30, 50, 75),
]
_WHOLE = {0, 2, 4}
PARTS["shipped"] = "\nUNION ALL ".join(
    f"SELECT '{row[0]}' AS shipped_id, " + ", ".join(
        f"CAST({v} AS {'BIGINT' if i in _WHOLE else 'DOUBLE'}) AS {_FIELDS[i]}" for i, v in enumerate(row[1:]))
    for row in _SHIPPED)
PARTS["chosen"] = """
SELECT 'cust-' || c_custkey AS tenant_id, 'nation-' || c_nationkey AS project_id, c_custkey, c_acctbal,
  ['base', 'jobforge', 'settler', 'readylayer', 'aias', 'keys', 'no-such-profile'][c_nationkey % 7 + 1] AS profile_id
FROM customer"""
PARTS["effective"] = """
SELECT c.tenant_id, c.project_id, c.profile_id, s.* EXCLUDE (shipped_id) REPLACE (
  CASE WHEN c_custkey % 4 = 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) ELSE refund_spike_threshold_cents END
    AS refund_spike_threshold_cents,
  CASE WHEN c_custkey % 5 = 0 THEN c_acctbal / 5000 ELSE payment_failure_spike_threshold END
    AS payment_failure_spike_threshold,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 20 ELSE dispute_spike_threshold END AS dispute_spike_threshold,
  CASE WHEN c_custkey % 9 = 0 THEN c_acctbal / 80 ELSE risk_score_high_threshold END AS risk_score_high_threshold)
FROM chosen c JOIN shipped s ON s.shipped_id = CASE WHEN c.profile_id = 'no-such-profile' THEN 'base' ELSE c.profile_id END"""
oracle("profile_thresholds", """
SELECT c.tenant_id, c.project_id, c.profile_id, s.* EXCLUDE (shipped_id) FROM chosen c
JOIN shipped s ON s.shipped_id = CASE WHEN c.profile_id = 'no-such-profile' THEN 'base' ELSE c.profile_id END""")
oracle("profile_effective", "SELECT * FROM effective")
oracle("profile_violations", """
SELECT tenant_id, project_id, 'profiles' AS table_name, profile_id AS row_key, violation FROM (
  SELECT *, unnest([
    CASE WHEN refund_spike_threshold_cents < 0 THEN 'refund_spike_threshold_cents: below 0' END,
    CASE WHEN payment_failure_spike_threshold < 0 OR payment_failure_spike_threshold > 1
         THEN 'payment_failure_spike_threshold: outside 0..1' END,
    CASE WHEN risk_score_high_threshold < 0 OR risk_score_high_threshold > 100
         THEN 'risk_score_high_threshold: outside 0..100' END]) AS violation FROM effective)
WHERE violation IS NOT NULL""")

# -- redaction ------------------------------------------------------------------------------------------
PARTS["planted"] = """
SELECT doc_id, text || CASE doc_id % 10
  WHEN 1 THEN ' AKIA' || 'ABCDEFGHIJKLMNOP'
  WHEN 2 THEN ' sk-' || 'abcdefghijklmnopqrst0123456789ab'
  WHEN 3 THEN ' sk_' || 'live_abcdefghijklmnopqrst0123456789'
  WHEN 4 THEN ' ghp_' || 'abcdefghijklmnopqrst0123456789abcdef'
  WHEN 5 THEN ' -----BEGIN RSA ' || 'PRIVATE KEY-----'
  WHEN 6 THEN ' my_api_key=' || 'abcdefghijklmnopqrst'
  WHEN 7 THEN ' my_auth_token: ' || 'abcdefghijklmnopqrst'
  WHEN 8 THEN ' my_client_secret=''' || 'abcdefghijklmnopqrst'''
  ELSE '' END AS text
FROM documents"""
_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _assigned(word: str) -> str:
    return rf"[a-zA-Z0-9_]+_{word}{_WS}*[:=]{_WS}*[''\"]?[a-zA-Z0-9_-]{{16,}}[''\"]?"


_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_SK = r"sk-[a-zA-Z0-9]{32,}"
_PEM = r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"


def _replaced(patterns: list[tuple[str, str, str]]) -> str:
    text = "text"
    for pattern, replacement, flags in patterns:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', '{flags}')"
    return text


_TYPED = [(_assigned("key"), "[REDACTED_KEY]", "gi"), (_assigned("token"), "[REDACTED_TOKEN]", "gi"),
          (_assigned("secret"), "[REDACTED_SECRET]", "gi"), (_SK, "[REDACTED_SK]", "g"), (_EMAIL, "[REDACTED_EMAIL]", "g")]
_INLINE = [("AKIA[0-9A-Z]{16}", "[REDACTED]", "g"), (_PEM, "[REDACTED]", "g"),
           ("sk_live_[0-9a-zA-Z]{24,}", "[REDACTED]", "g"), (_SK, "[REDACTED]", "g"),
           ("ghp_[0-9a-zA-Z]{36}", "[REDACTED]", "g"), (_assigned("key"), "[REDACTED]", "gi"),
           (_assigned("token"), "[REDACTED]", "gi"), (_assigned("secret"), "[REDACTED]", "gi")]
_LIST = [(_EMAIL, "[REDACTED_EMAIL]", "g"), ("[a-zA-Z0-9_-]{24,}", "[REDACTED_TOKEN]", "g")]
_ANY = f"AKIA[0-9A-Z]{{16}}|{_PEM}|sk_live_[0-9a-zA-Z]{{24,}}|{_SK}|ghp_[0-9a-zA-Z]{{36}}|{_EMAIL}"
oracle("redact_typed", f"SELECT doc_id, {_replaced(_TYPED)} AS text FROM planted")
oracle("redact_inline", f"SELECT doc_id, {_replaced(_INLINE)} AS text FROM planted")
oracle("redact_whole_value", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{_ANY}') THEN '[REDACTED]' ELSE text END AS text FROM planted""")
oracle("redact_pattern_list", f"SELECT doc_id, {_replaced(_LIST)} AS text FROM planted")
oracle("redact_hits", "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT doc_id, '{name}' AS pattern, CAST(len(regexp_extract_all({_replaced(_TYPED[:i])}, "
    f"'{'(?i)' if 'i' in _TYPED[i][2] else ''}{_TYPED[i][0]}')) AS BIGINT) AS hits FROM planted"
    for i, name in enumerate(["key", "token", "secret", "sk", "email"])) + ") WHERE hits > 0")
oracle("redact_conversations", f"SELECT * REPLACE ({_replaced(_LIST)} AS text) FROM conversations")
oracle("redact_payload_keys", """
SELECT event_id, '{"event":' || event_id || ',"API_KEY":"[REDACTED]","nested":{"userPassword":"[REDACTED]","kind":"'
  || event_type || '","list":["plain","' || CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' ELSE 'nobody' END
  || '"]},"tokens":"[REDACTED]"}' AS payload
FROM events""")

oracle("redact_typed_rows", """
SELECT event_id, '{"auth_token":"[REDACTED]","n":"' || event_id || '"}' AS counts,
  '{"password":"[REDACTED]","kind":"' || event_type || '"}' AS login, '[{"secret":"[REDACTED]","n":' || event_id || '}]' AS lists,
  '{"a":{"password":"[REDACTED]"},"n":' || event_id || '}' AS free, '[REDACTED]' AS api_key,
  CASE event_id % 5 WHEN 0 THEN '[REDACTED]' WHEN 1 THEN '{"n": ' || event_id || '}'
    ELSE '{"n":' || event_id || ',"token":"[REDACTED]"}' END AS payload
FROM events""")

# -- runner metrics ---------------------------------------------------------------------------------------
PARTS["runs"] = """
SELECT 'runner-' || (u % 4) AS runner_id, ['autopilot.finops.reconcile', 'autopilot.finops.anomaly_scan',
  'autopilot.finops.churn_risk_report', 'finops.cost_snapshot'][u % 4 + 1] AS job_type,
  date_trunc('day', src.ts) AS d, src.*, CAST(floor(x.value * 10) AS BIGINT) AS latency
FROM src JOIN events x ON x.event_id = src.e"""
PARTS["rolled"] = f"""
SELECT runner_id, job_type, {iso('CAST(d AS TIMESTAMP)')} AS window_start,
  {iso('CAST(d AS TIMESTAMP) + to_days(1)')} AS window_end, {iso('CAST(d AS TIMESTAMP) + to_days(1)')} AS captured_at,
  count(*) FILTER (WHERE rt <> 'error') AS success_count, count(*) FILTER (WHERE rt = 'error') AS failure_count,
  CAST(sum(CASE k % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS retry_count,
  count(*) FILTER (WHERE e % 97 = 0) AS idempotent_replay_count, CAST(sum(cents) AS BIGINT) AS input_records,
  CAST(sum(k) AS BIGINT) AS output_records, quantile_disc(latency, 0.5) AS latency_ms_p50,
  quantile_disc(latency, 0.95) AS latency_ms_p95
FROM runs GROUP BY runner_id, job_type, d"""
oracle("runner_metrics_rollup", """
SELECT *, CASE
  WHEN job_type = 'autopilot.finops.reconcile' AND input_records > 100000 THEN 'unbounded_input'
  WHEN job_type = 'autopilot.finops.anomaly_scan' AND output_records > 1000 THEN 'high_anomaly_volume'
  WHEN job_type = 'autopilot.finops.churn_risk_report' AND retry_count > 10 THEN 'excessive_retry'
  WHEN job_type = 'finops.cost_snapshot' AND output_records > 1000 THEN 'unbounded_line_items'
  ELSE '' END AS cost_risk_flags
FROM rolled""")
oracle("runner_metrics_violations", """
SELECT 'runner_metrics' AS table_name, runner_id || '/' || job_type || '/' || substr(window_start, 1, 10) AS row_key,
  violation FROM (SELECT *, unnest([CASE WHEN retry_count - 10 < 0 THEN 'retry_count: below 0' END,
    CASE WHEN output_records % 3 = 0 THEN 'latency_ms_p50: required' END]) AS violation FROM rolled)
WHERE violation IS NOT NULL""")
