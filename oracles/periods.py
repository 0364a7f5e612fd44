"""Sub-queries of the analysis where every tenant has a period of its own."""

from __future__ import annotations

import re

from oracles.findings import PARTS, REPORT, anomaly_sql
from oracles.parts import iso, ledger_parts

# The periods that are given; what a tenant lacks comes from its events.
STARTS = {"tenant-0": "2024-01-05T00:00:00Z"}
ENDS = {"tenant-0": "2024-01-20T23:59:59.999Z", "tenant-1": "2024-01-25T12:00:00Z"}
REFERENCES = {"tenant-1": "2024-02-10T00:00:00Z"}


def cases(values: dict[str, str], otherwise: str) -> str:
    return "CASE tenant_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


PARTS["own_ends"] = f"""
SELECT tenant_id, project_id, {cases(STARTS, iso("first_at"))} AS period_start, {cases(ENDS, iso("last_at"))} AS period_end
FROM (SELECT tenant_id, project_id, min("timestamp") AS first_at, max("timestamp") AS last_at FROM billing GROUP BY ALL)"""
PARTS["own_periods"] = f"""
SELECT *, {cases(REFERENCES, "period_end")} AS reference_date FROM own_ends"""

ledger_parts("o_", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z")
PARTS["o_period"] = """
SELECT n.* FROM numbered n JOIN own_periods USING (tenant_id, project_id)
WHERE "timestamp" >= CAST(rtrim(period_start, 'Z') AS TIMESTAMP) AND "timestamp" <= CAST(rtrim(period_end, 'Z') AS TIMESTAMP)"""


def own(name: str, *sources: str) -> None:
    """A part as it is, but reading the tables of the tenants' own periods."""
    body = PARTS[name]
    for source in sources:
        body = re.sub(rf"\b(FROM|JOIN|,) {source}\b", rf"\1 o_{source}", body)
    PARTS[f"o_{name}"] = body


own("disc", "subs", "cust")
own("refunds", "totals")
own("disputes", "totals")
own("attempts", "cust")
PARTS["o_undated"] = "\nUNION ALL".join(anomaly_sql(REPORT).values())
for _name in ("subs", "refunds", "disputes", "attempts"):
    PARTS["o_undated"] = PARTS["o_undated"].replace(f"FROM {_name}", f"FROM o_{_name}")
PARTS["o_r_anomalies"] = f"""
SELECT a.* REPLACE ({iso("CAST(rtrim(o.reference_date, 'Z') AS TIMESTAMP)")} AS detected_at)
FROM o_undated a JOIN own_periods o USING (tenant_id, project_id)"""
own("found", "disc", "r_anomalies")
own("placed", "found")
PARTS["o_summed"] = """
SELECT t.tenant_id, t.project_id, p.period_start, p.period_end,
  t.event_count, t.event_count AS normalized_event_count, t.total_customers AS ledger_customer_count,
  t.total_mrr_cents AS ledger_mrr_cents,
  (SELECT count(*) FROM o_disc d WHERE d.tenant_id = t.tenant_id) AS reconciliation_discrepancies,
  (SELECT count(*) FROM o_r_anomalies a WHERE a.tenant_id = t.tenant_id) AS anomaly_count,
  (SELECT count(*) FROM r_risks r WHERE r.tenant_id = t.tenant_id) AS churn_risk_count,
  CAST(0 AS BIGINT) AS job_request_count
FROM o_totals t JOIN own_periods p USING (tenant_id, project_id)"""
PARTS["o_reconciled"] = """
SELECT t.tenant_id, t.project_id, concat_ws('-', 'recon', t.tenant_id, t.project_id, p.period_start, p.period_end) AS report_id,
  p.period_start, p.period_end, t.total_mrr_cents AS total_expected_mrr_cents, t.total_paid_cents AS total_observed_mrr_cents,
  t.total_mrr_cents - t.total_paid_cents AS total_difference_cents,
  (SELECT count(*) FROM o_disc d WHERE d.tenant_id = t.tenant_id) AS discrepancy_count,
  (SELECT count(*) FROM o_cust c WHERE c.tenant_id = t.tenant_id AND c.payment_failure_count_30d > 0
     AND c.last_payment_at IS NULL) AS missing_event_count,
  t.total_mrr_cents = t.total_paid_cents AND NOT EXISTS (SELECT 1 FROM o_disc d WHERE d.tenant_id = t.tenant_id) AS is_balanced
FROM o_totals t JOIN own_periods p USING (tenant_id, project_id)"""
