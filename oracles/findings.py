"""Sub-queries for anomalies, churn risks and findings, for a given set of thresholds."""

from __future__ import annotations

from oracles.parts import CHURN_REFERENCE, PARTS, REFERENCE, iso, ts

ID16 = "substr(sha256('{kind}' || ':' || tenant_id || ':' || project_id || ':' || {ref}), 1, 16)"
BASE = dict(refund_cents=100000, refund_pct=10.0, disputes=5, failure=0.25, window=300,
            w_pay=0.3, w_use=0.25, w_tick=0.2, w_down=0.15, w_idle=0.1, low=30, medium=50, high=75)
REPORT = BASE | dict(refund_cents=50000, failure=0.2, w_pay=0.35, w_use=0.3)

MONEY = "{x} // 100 || '.' || lpad(CAST({x} % 100 AS VARCHAR), 2, '0')"


def anomaly(kind: str, source: str, ref: str, severity: str, description: str, confidence: str, action: str,
            customer: str = "NULL", subscription: str = "NULL", expected: str = "NULL", observed: str = "NULL",
            difference: str = "NULL") -> str:
    return f"""
SELECT tenant_id, project_id, 'anomaly-{kind}-' || {ID16.format(kind=kind, ref=ref)} AS anomaly_id,
  '{kind}' AS anomaly_type, {severity} AS severity, {iso(ts(REFERENCE))} AS detected_at, {ref} AS reference,
  CAST({customer} AS VARCHAR) AS customer_id, CAST({subscription} AS VARCHAR) AS subscription_id,
  {description} AS description, CAST({expected} AS DOUBLE) AS expected_value,
  CAST({observed} AS DOUBLE) AS observed_value, CAST({difference} AS DOUBLE) AS difference,
  CAST({confidence} AS DOUBLE) AS confidence, '{action}' AS recommended_action
FROM {source}"""


PARTS["chain"] = """
SELECT *, row_number() OVER w AS pos, floor(epoch_us("timestamp") / 1000) - floor(epoch_us(lag("timestamp") OVER w) / 1000) AS gap
FROM billing WINDOW w AS (PARTITION BY tenant_id, project_id, event_id ORDER BY "timestamp", ingest_seq)"""

PARTS["paid_invoices"] = """
SELECT * FROM numbered WHERE event_type IN ('invoice_paid', 'payment_succeeded') AND invoice_id IS NOT NULL"""

PARTS["charged"] = """
SELECT p.tenant_id, p.project_id, p.invoice_id, any_value(f.customer_id) AS customer_id,
  coalesce(any_value(f.amount_cents), 0) AS first_amount, CAST(coalesce(sum(p.amount_cents), 0) AS BIGINT) AS total,
  count(*) FILTER (WHERE p.amount_cents = coalesce(f.amount_cents, 0)) AS same
FROM paid_invoices p JOIN paid_invoices f
  ON f.tenant_id = p.tenant_id AND f.invoice_id = p.invoice_id
 AND f.rn = (SELECT min(rn) FROM paid_invoices q WHERE q.tenant_id = p.tenant_id AND q.invoice_id = p.invoice_id)
GROUP BY p.tenant_id, p.project_id, p.invoice_id"""

for _name, _types in (
    ("refunds", "'invoice_refunded', 'refund_issued'"),
    ("disputes", "'invoice_disputed', 'dispute_created', 'dispute_lost'"),
):
    PARTS[_name] = f"""
SELECT b.tenant_id, b.project_id, count(*) AS n, CAST(coalesce(sum(b.amount_cents), 0) AS BIGINT) AS cents,
  any_value(t.total_paid_cents) AS revenue,
  CASE WHEN any_value(t.total_paid_cents) > 0
       THEN coalesce(sum(b.amount_cents), 0) / any_value(t.total_paid_cents) * 100 ELSE 0.0 END AS pct
FROM billing b JOIN totals t USING (tenant_id, project_id) WHERE b.event_type IN ({_types}) GROUP BY ALL"""

PARTS["attempts"] = """
SELECT *, payment_failure_count_30d + (last_payment_at IS NOT NULL)::INTEGER AS tries,
  payment_failure_count_30d / (payment_failure_count_30d + (last_payment_at IS NOT NULL)::INTEGER) AS rate
FROM cust WHERE payment_failure_count_30d > 0 OR last_payment_at IS NOT NULL"""

PARTS["by_sub"] = """
SELECT *, count(*) OVER (PARTITION BY tenant_id, subscription_id) AS n,
  coalesce(max((event_type = 'subscription_created')::INTEGER) OVER w, 0) AS seen_create,
  coalesce(max((event_type = 'subscription_cancelled')::INTEGER) OVER w, 0) AS seen_cancel
FROM billing WHERE subscription_id IS NOT NULL
WINDOW w AS (PARTITION BY tenant_id, subscription_id ORDER BY "timestamp", event_id, ingest_seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def anomaly_sql(t: dict) -> dict[str, str]:
    dup = f"""(SELECT tenant_id, project_id, event_id, min(pos) AS pos, arg_min(gap, pos) AS gap,
        arg_min(event_type, pos) AS event_type, arg_min(customer_id, pos) AS customer_id
        FROM chain WHERE gap < {t['window']} * 1000 GROUP BY 1, 2, 3)"""
    pct = "printf('%.1f', pct)"
    return {
        "duplicate_event": anomaly(
            "duplicate_event", dup, "event_id", "'high'",
            "'Duplicate event detected: ' || event_id || ' (' || event_type || ') within ' "
            "|| CAST(floor(gap / 1000 + 0.5) AS BIGINT) || 's'",
            "1.0", "Review event ingestion pipeline for duplicate handling", "customer_id", expected="1",
            observed="pos", difference="pos - 1"),
        "missing_invoice": anomaly(
            "missing_invoice",
            "(SELECT * FROM subs s WHERE status = 'active' AND mrr_cents > 0 AND NOT EXISTS (SELECT 1 FROM billing b "
            "WHERE b.tenant_id = s.tenant_id AND b.subscription_id = s.subscription_id "
            "AND b.event_type IN ('invoice_paid', 'invoice_failed')))",
            "subscription_id", "'medium'",
            "'Active subscription ' || subscription_id || ' has no invoice events in period'", "0.8",
            "Verify invoice generation and payment collection for this subscription", "customer_id",
            "subscription_id", "mrr_cents", "0", "mrr_cents"),
        "double_charge": anomaly(
            "double_charge", "charged WHERE same > 1", "invoice_id", "'critical'",
            "'Potential double charge: ' || same || ' payments of ' || first_amount || ' cents for invoice ' || invoice_id",
            "0.9", "Immediately review and refund duplicate charges", "customer_id",
            expected="first_amount", observed="total", difference="total - first_amount"),
        "refund_spike": anomaly(
            "refund_spike", f"refunds WHERE cents > {t['refund_cents']}", "'total'",
            f"CASE WHEN pct > {t['refund_pct']} THEN 'critical' ELSE 'high' END",
            f"'Refund spike detected: $' || {MONEY.format(x='cents')} || ' in refunds (' || {pct} || '% of revenue)'",
            f"least(pct / CAST({t['refund_pct']} AS DOUBLE), 1.0)", "Review refund patterns and identify root cause",
            expected=f"CAST(revenue * CAST({t['refund_pct']} AS DOUBLE) / 100 AS DOUBLE)", observed="cents",
            difference=f"cents - CAST(revenue * CAST({t['refund_pct']} AS DOUBLE) / 100 AS DOUBLE)"),
        "dispute_spike": anomaly(
            "dispute_spike", f"disputes WHERE n >= {t['disputes']}", "'total'",
            f"CASE WHEN n > {t['disputes']} * 2 THEN 'critical' ELSE 'high' END",
            f"'Dispute spike: ' || n || ' disputes ($' || {MONEY.format(x='cents')} || ', ' || {pct} || '% of revenue)'",
            f"least(n / ({t['disputes']} * 2), 1.0)", "Review fraud patterns and improve dispute prevention",
            expected=str(t["disputes"]), observed="n", difference=f"n - {t['disputes']}"),
        "payment_failure_spike": anomaly(
            "payment_failure_spike", f"attempts WHERE rate >= {t['failure']}", "customer_id",
            "CASE WHEN rate > 0.5 THEN 'critical' ELSE 'high' END",
            "'Payment failure spike: ' || payment_failure_count_30d || ' failures in 30 days (' "
            "|| CAST(floor(rate * 100 + 0.5) AS BIGINT) || '% rate)'",
            "rate", "Review payment method and consider customer outreach", "customer_id",
            expected=f"CAST({t['failure']} AS DOUBLE) * tries", observed="payment_failure_count_30d",
            difference=f"payment_failure_count_30d - CAST({t['failure']} AS DOUBLE) * tries"),
        "cancel_before_create": anomaly(
            "out_of_sequence", "by_sub WHERE n >= 2 AND event_type = 'subscription_cancelled' AND seen_create = 0",
            "event_id", "'medium'", "'Cancel event before create for subscription ' || subscription_id", "0.9",
            "Review event data integrity", "customer_id", "subscription_id"),
        "payment_after_cancel": anomaly(
            "out_of_sequence",
            "by_sub WHERE n >= 2 AND event_type IN ('invoice_paid', 'payment_succeeded') AND seen_cancel = 1",
            "event_id", "'low'", "'Payment event after cancellation for subscription ' || subscription_id", "0.6",
            "Verify if payment is legitimate or requires refund", "customer_id", "subscription_id"),
    }


ANOMALY = anomaly_sql(BASE)
PARTS["anomalies"] = "\nUNION ALL".join(ANOMALY.values())
PARTS["r_anomalies"] = "\nUNION ALL".join(anomaly_sql(REPORT).values())

# -- churn -----------------------------------------------------------------------
PARTS["usage"] = """
SELECT user_id, event_type, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS DOUBLE) AS prev,
       CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS DOUBLE) AS cur
FROM events GROUP BY 1, 2"""
PARTS["drops"] = """
SELECT 'cus_' || user_id AS customer_id, event_type AS metric_name, prev, cur, (prev - cur) / prev * 100 AS pct,
  row_number() OVER (PARTITION BY user_id ORDER BY (prev - cur) / prev * 100 DESC, event_type) AS nth
FROM usage WHERE prev > 0 AND (prev - cur) / prev * 100 > 30"""
PARTS["tickets"] = """
SELECT 'cus_' || o_custkey AS customer_id, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s
FROM orders"""
PARTS["plans"] = """
SELECT *, lag(plan_id) OVER (PARTITION BY tenant_id, subscription_id ORDER BY "timestamp", event_id, ingest_seq) AS was
FROM billing WHERE plan_id IS NOT NULL"""
PARTS["downs"] = """
SELECT * FROM plans WHERE plan_id < was"""


def facts_part(p: str, dates: str) -> None:
    """Facts per customer; `dates` gives tenant_id and ref, the reference date as text."""
    PARTS[f"{p}facts"] = f"""
SELECT c.tenant_id, c.project_id, c.customer_id, c.total_mrr_cents, c.subscription_count,
  c.payment_failure_count_30d AS f,
  (SELECT count(*) FROM usage u WHERE 'cus_' || u.user_id = c.customer_id) AS n_usage,
  d.metric_name, d.prev, d.cur, d.pct,
  (SELECT count(*) FROM tickets t WHERE t.customer_id = c.customer_id) AS n_tick,
  (SELECT count(*) FROM tickets t WHERE t.customer_id = c.customer_id AND s IN ('O', 'P')) AS n_open,
  (SELECT count(*) FROM tickets t WHERE t.customer_id = c.customer_id AND p = '1') AS n_crit,
  (SELECT count(*) FROM tickets t WHERE t.customer_id = c.customer_id AND p = '2') AS n_high,
  (SELECT count(*) FROM downs x WHERE x.customer_id = c.customer_id) AS n_down,
  (SELECT count(*) FROM downs x WHERE x.customer_id = c.customer_id
     AND (floor(epoch_us(CAST(rtrim(r.ref, 'Z') AS TIMESTAMP)) / 1000) - floor(epoch_us(x."timestamp") / 1000)) / 86400000.0 <= 30) AS n_recent,
  CAST(floor(epoch_us(CAST(rtrim(r.ref, 'Z') AS TIMESTAMP)) / 1000) - floor(epoch_us(c.last_payment_at) / 1000) AS DOUBLE) / 86400000.0 AS idle, r.ref
FROM ch_cust c JOIN ({dates}) r USING (tenant_id) LEFT JOIN (SELECT * FROM drops WHERE nth = 1) d USING (customer_id)"""


facts_part("", f"SELECT DISTINCT tenant_id, '{CHURN_REFERENCE}' AS ref FROM billing")
facts_part("d_", f"""SELECT tenant_id, {iso("date_trunc('day', max(\"timestamp\")) + to_days(CAST(substr(tenant_id, 8) AS INT) * 9 + 21)")} AS ref
FROM billing GROUP BY 1""")


def churn_parts(p: str, t: dict, facts: str = "facts") -> None:
    PARTS[f"{p}weights"] = f"""
SELECT *,
  CASE WHEN f > 0 THEN least({t['w_pay']}::DOUBLE * least(f * 0.2::DOUBLE, 2.0::DOUBLE), 0.9::DOUBLE) END AS w1,
  CASE WHEN pct IS NOT NULL THEN {t['w_use']}::DOUBLE * least(pct / 100, 1.0::DOUBLE) END AS w2,
  CASE WHEN n_tick > 0 THEN least({t['w_tick']}::DOUBLE * (CASE WHEN n_crit > 0 THEN 2.0 WHEN n_high > 0 THEN 1.5
       WHEN n_open > 3 THEN 1.3 ELSE 1.0 END)::DOUBLE * sqrt(n_tick), 0.9::DOUBLE) END AS w3,
  CASE WHEN n_down > 0 THEN least({t['w_down']}::DOUBLE * (1.0::DOUBLE + n_recent * 0.5::DOUBLE), 0.8::DOUBLE) END AS w4,
  CASE WHEN total_mrr_cents <> 0 AND (idle IS NULL OR idle >= 35)
       THEN {t['w_idle']}::DOUBLE * coalesce(least(idle / 90, 1.0::DOUBLE), 1.0::DOUBLE) END AS w5
FROM {facts}"""
    PARTS[f"{p}scored"] = f"""
SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(least(weighted * (1.0::DOUBLE + (n - 1) * 0.1::DOUBLE), 100.0::DOUBLE)
       + 0.5) AS BIGINT) END AS risk_score
FROM (SELECT *, (w1 IS NOT NULL)::INT + (w2 IS NOT NULL)::INT + (w3 IS NOT NULL)::INT + (w4 IS NOT NULL)::INT
        + (w5 IS NOT NULL)::INT AS n,
      0.0::DOUBLE + coalesce(w1 * 100, 0) + coalesce(w2 * 100, 0) + coalesce(w3 * 100, 0) + coalesce(w4 * 100, 0)
        + coalesce(w5 * 100, 0) AS weighted
      FROM {p}weights)"""
    PARTS[f"{p}signals"] = f"""
SELECT tenant_id, customer_id, 1 AS i, 'payment failures' AS name, w1 AS w,
  'Payment: Review billing settings and payment methods' AS act FROM {p}weights WHERE w1 IS NOT NULL
UNION ALL SELECT tenant_id, customer_id, 2, 'usage drop', w2,
  'Usage: Investigate adoption blockers with customer' FROM {p}weights WHERE w2 IS NOT NULL
UNION ALL SELECT tenant_id, customer_id, 3, 'support tickets', w3,
  'Support: Ensure all tickets resolved satisfactorily' FROM {p}weights WHERE w3 IS NOT NULL
UNION ALL SELECT tenant_id, customer_id, 4, 'plan downgrade', w4,
  'Revenue: Explore upgrade incentives or alternative plans' FROM {p}weights WHERE w4 IS NOT NULL
UNION ALL SELECT tenant_id, customer_id, 5, 'no recent login', w5,
  'Engagement: Send re-activation campaign' FROM {p}weights WHERE w5 IS NOT NULL"""
    PARTS[f"{p}told"] = f"""
SELECT tenant_id, customer_id,
  string_agg(name || ' (' || CAST(floor(w * 100 + 0.5) AS BIGINT) || '% impact)', ', ' ORDER BY w DESC, i) AS parts,
  string_agg(act, ' | ' ORDER BY w DESC, i) AS acts
FROM {p}signals GROUP BY 1, 2"""
    PARTS[f"{p}risks"] = f"""
SELECT s.tenant_id, s.project_id, s.customer_id,
  'churn-' || substr(sha256(s.tenant_id || ':' || s.project_id || ':' || s.customer_id || ':' || s.ref), 1, 16) AS risk_id,
  s.ref AS calculated_at, s.risk_score,
  CASE WHEN s.risk_score >= {t['high']} THEN 'critical' WHEN s.risk_score >= {t['medium']} THEN 'high'
       WHEN s.risk_score >= {t['low']} THEN 'medium' ELSE 'low' END AS risk_level,
  s.n AS signal_count, s.total_mrr_cents AS mrr_cents, s.subscription_count, s.f AS payment_failures_30d,
  s.n_usage AS usage_metrics_count, s.n_tick AS support_tickets_count, s.n_down AS plan_downgrades_count,
  CASE WHEN s.n = 0 THEN 'Customer ' || s.customer_id || ' shows no significant churn risk signals.'
       ELSE 'Customer ' || s.customer_id || ' has risk score ' || s.risk_score || '/100 based on: ' || t.parts || '.' END
    AS explanation,
  t.acts
FROM {p}scored s LEFT JOIN {p}told t ON t.tenant_id = s.tenant_id AND t.customer_id = s.customer_id"""
    PARTS[f"{p}advised"] = f"""
SELECT *, concat_ws(' | ', CASE risk_level
    WHEN 'critical' THEN 'Immediate: Contact customer success team for intervention'
    WHEN 'high' THEN 'Schedule proactive customer outreach within 48 hours'
    WHEN 'medium' THEN 'Monitor for additional signals; include in next health review' END, acts) AS recommended_actions
FROM {p}risks"""


churn_parts("", BASE | dict(w_pay=0.1, w_tick=0.02, w_down=0.1))
churn_parts("r_", REPORT)
churn_parts("d_", BASE | dict(w_pay=0.1, w_tick=0.02, w_down=0.1), "d_facts")

# -- findings (report thresholds) --------------------------------------------------
PARTS["found"] = """
SELECT tenant_id, project_id, 'recon-' || subscription_id AS finding_id,
  'MRR discrepancy for ' || subscription_id AS title,
  'Detected ' || reason || ' with ' || difference_cents || ' cents difference.' AS description,
  CASE WHEN abs(difference_cents) > 1000 THEN 'high' ELSE 'medium' END AS severity, 'reconciliation' AS category,
  ['subscription_id: ' || subscription_id, 'difference_cents: ' || difference_cents, 'reason: ' || reason] AS evidence,
  generation AS tie
FROM disc
UNION ALL
SELECT tenant_id, project_id, anomaly_id, 'Anomaly: ' || replace(anomaly_type, '_', ' '), description, severity,
  'anomaly', ['anomaly_id: ' || anomaly_id, 'type: ' || anomaly_type], 0
FROM r_anomalies
UNION ALL
SELECT tenant_id, project_id, risk_id, 'Churn risk: ' || customer_id, explanation, risk_level, 'churn',
  ['customer_id: ' || customer_id, 'risk_level: ' || risk_level], 0
FROM r_risks"""
PARTS["placed"] = """
SELECT *, row_number() OVER (PARTITION BY tenant_id, project_id ORDER BY
  list_position(['critical', 'high', 'medium', 'low', 'info'], severity), finding_id, tie, description) AS finding_rank
FROM found"""
PARTS["advice"] = """
SELECT DISTINCT tenant_id, project_id, recommended_action AS recommendation FROM r_anomalies
UNION
SELECT tenant_id, project_id, unnest(string_split(recommended_actions, ' | ')) FROM r_advised
WHERE recommended_actions <> ''"""
PARTS["summed"] = f"""
SELECT t.tenant_id, t.project_id, '2024-01-03T00:00:00Z' AS period_start, '2024-01-28T23:59:59.999Z' AS period_end,
  t.event_count, t.event_count AS normalized_event_count, t.total_customers AS ledger_customer_count,
  t.total_mrr_cents AS ledger_mrr_cents,
  (SELECT count(*) FROM disc d WHERE d.tenant_id = t.tenant_id) AS reconciliation_discrepancies,
  (SELECT count(*) FROM r_anomalies a WHERE a.tenant_id = t.tenant_id) AS anomaly_count,
  (SELECT count(*) FROM r_risks r WHERE r.tenant_id = t.tenant_id) AS churn_risk_count,
  CAST(0 AS BIGINT) AS job_request_count
FROM totals t"""
PARTS["documents_json"] = """
SELECT s.*, 'trace-main' AS trace_id,
  'finops-report-' || substr(sha256('{"project_id":"' || s.project_id || '","tenant_id":"' || s.tenant_id
     || '","trace_id":"trace-main"}'), 1, 12) AS report_id,
  (SELECT count(*) FROM found f WHERE f.tenant_id = s.tenant_id) AS finding_count,
  '{"generated_at":"1970-01-01T00:00:00.000Z","metadata":{"event_envelope_count":0,"run_manifest_count":0},'
  || '"module_id":"finops","project_id":"' || s.project_id || '","recommendations":'
  || (SELECT to_json(list(recommendation ORDER BY recommendation)) FROM advice a WHERE a.tenant_id = s.tenant_id)
  || ',"report_id":"finops-report-' || substr(sha256('{"project_id":"' || s.project_id || '","tenant_id":"' || s.tenant_id
     || '","trace_id":"trace-main"}'), 1, 12)
  || '","report_type":"finops","schema_version":"1.0.0","summary":{"anomaly_count":' || s.anomaly_count
  || ',"churn_risk_count":' || s.churn_risk_count || ',"event_count":' || s.event_count || ',"job_request_count":'
  || s.job_request_count || ',"ledger_customer_count":' || s.ledger_customer_count || ',"ledger_mrr_cents":'
  || s.ledger_mrr_cents || ',"normalized_event_count":' || s.normalized_event_count || ',"period_end":"' || s.period_end
  || '","period_start":"' || s.period_start || '","reconciliation_discrepancies":' || s.reconciliation_discrepancies
  || '},"tenant_id":"' || s.tenant_id || '","trace_id":"trace-main"}' AS head
FROM summed s"""
