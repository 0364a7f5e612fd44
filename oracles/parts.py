"""Named sub-queries shared by the SQL oracles, and the helper that puts them together.

The SQL is written independently of the Spark code: the billing view is a union
where Spark explodes copies, the ledger is an as-of join where Spark numbers
generations, ordered checks are correlated comparisons or plain windows.
"""

from __future__ import annotations

import re

PERIOD_A, PERIOD_B = "2024-01-03T00:00:00Z", "2024-01-28T23:59:59.999Z"
REFERENCE, CHURN_REFERENCE = "2024-02-20T00:00:00Z", "2024-02-28T00:00:00Z"


def ts(text: str) -> str:
    return f"TIMESTAMP '{text.replace('T', ' ').rstrip('Z')}'"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ')"


PARTS: dict[str, str] = {}

PARTS["src"] = r"""
SELECT event_id AS e, user_id AS u, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) AS k,
       ts, event_type AS rt, CAST(round(value * 100) AS BIGINT) AS cents
FROM events"""

PARTS["typed"] = """
SELECT *, CASE
  WHEN rt = 'signup' THEN CASE k % 4 WHEN 0 THEN 'subscription_cancelled' WHEN 1 THEN 'subscription_updated'
                          ELSE 'subscription_created' END
  WHEN rt = 'purchase' THEN CASE k % 10 WHEN 0 THEN 'invoice_refunded' WHEN 1 THEN 'invoice_disputed'
                          WHEN 2 THEN 'dispute_lost' WHEN 3 THEN 'refund_issued' ELSE 'invoice_paid' END
  WHEN rt = 'error' THEN CASE k % 5 WHEN 0 THEN 'invoice_failed' WHEN 1 THEN 'dispute_created'
                          ELSE 'payment_failed' END
  WHEN rt = 'click' THEN CASE WHEN k % 2 = 0 THEN 'payment_succeeded' WHEN k % 25 = 1 THEN 'dispute_won'
                          ELSE 'usage_recorded' END
  WHEN rt = 'view' THEN 'usage_recorded' END AS event_type
FROM src"""

PARTS["single"] = """
SELECT e, 'tenant-' || (u % 3) AS tenant_id, 'project-main' AS project_id, 'evt_' || e AS event_id, event_type,
       ts AS "timestamp", 'cus_' || u AS customer_id,
       CASE WHEN event_type LIKE 'subscription%' OR k % 7 <> 0 THEN 'sub_' || u || '_' || (e % 3) END AS subscription_id,
       CASE WHEN regexp_matches(event_type, '^(invoice|refund|dispute)_') THEN 'inv_' || e END AS invoice_id,
       CASE WHEN event_type IN ('subscription_cancelled', 'payment_failed') THEN NULL
            WHEN event_type = 'subscription_updated' AND k % 3 = 0 THEN NULL ELSE cents END AS amount_cents,
       CASE WHEN u % 3 = 2 AND k % 50 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       CASE WHEN event_type IN ('subscription_created', 'subscription_updated') AND k % 3 <> 1
            THEN 'plan_' || (k % 5) END AS plan_id,
       e AS ingest_seq
FROM typed"""

PARTS["billing"] = """
SELECT * FROM single
UNION ALL
SELECT * REPLACE ("timestamp" + to_seconds(e % 600) AS "timestamp", e + 1000000000 AS ingest_seq)
FROM single WHERE e % 97 = 0
UNION ALL
SELECT * REPLACE (event_id || '_dc' AS event_id, "timestamp" + to_seconds(120) AS "timestamp",
                  e + 2000000000 AS ingest_seq)
FROM single WHERE event_type = 'invoice_paid' AND e % 23 = 0"""

PARTS["numbered"] = 'SELECT *, row_number() OVER (ORDER BY "timestamp", event_id, ingest_seq) AS rn FROM billing'


def ledger_parts(prefix: str, a: str, b: str, source: str = "numbered") -> None:
    """`<prefix>subs`, `<prefix>cust`, `<prefix>totals`: the ledger of one period."""
    p = prefix
    PARTS[f"{p}period"] = f'SELECT * FROM {source} WHERE "timestamp" >= {ts(a)} AND "timestamp" <= {ts(b)}'
    PARTS[f"{p}opened"] = f"""
SELECT tenant_id, subscription_id, rn AS opened, customer_id AS owner,
       row_number() OVER (PARTITION BY tenant_id, subscription_id ORDER BY rn) AS generation
FROM {p}period WHERE event_type = 'subscription_created'"""
    PARTS[f"{p}member"] = f"""
SELECT s.*, o.opened, o.owner, o.generation
FROM (SELECT * FROM {p}period WHERE event_type LIKE 'subscription%') s
ASOF JOIN {p}opened o
  ON s.tenant_id = o.tenant_id AND s.subscription_id = o.subscription_id AND s.rn >= o.opened"""
    PARTS[f"{p}subs"] = f"""
SELECT tenant_id, project_id, subscription_id, generation, any_value(owner) AS customer_id,
       coalesce(arg_max(plan_id, rn) FILTER (WHERE plan_id IS NOT NULL AND event_type <> 'subscription_cancelled'),
                'unknown') AS plan_id,
       CASE WHEN bool_or(event_type = 'subscription_cancelled') THEN 'canceled' ELSE 'active' END AS status,
       min("timestamp") AS created_at,
       arg_max(coalesce(amount_cents, 0), rn) FILTER (WHERE event_type = 'subscription_created'
               OR (event_type = 'subscription_updated' AND amount_cents IS NOT NULL)) AS mrr_cents,
       arg_max(currency, rn) FILTER (WHERE event_type <> 'subscription_cancelled') AS currency,
       max("timestamp") FILTER (WHERE event_type = 'subscription_cancelled') AS canceled_at
FROM {p}member GROUP BY tenant_id, project_id, subscription_id, generation"""
    PARTS[f"{p}touch"] = f"""
SELECT tenant_id, project_id, customer_id, "timestamp", event_type, amount_cents FROM {p}period
WHERE event_type IN ('invoice_paid', 'invoice_refunded', 'invoice_disputed', 'payment_succeeded', 'payment_failed')
UNION ALL
SELECT tenant_id, project_id, customer_id, "timestamp", event_type, NULL FROM {p}member"""
    PARTS[f"{p}plain"] = f"""
SELECT tenant_id, project_id, customer_id,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE event_type = 'invoice_paid'), 0) AS BIGINT) AS total_paid_cents,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE event_type = 'invoice_refunded'), 0) AS BIGINT) AS total_refunded_cents,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE event_type = 'invoice_disputed'), 0) AS BIGINT) AS total_disputed_cents,
  max("timestamp") FILTER (WHERE event_type = 'invoice_paid') AS last_invoice_at,
  max("timestamp") FILTER (WHERE event_type = 'payment_succeeded') AS last_payment_at,
  count(*) FILTER (WHERE event_type = 'payment_failed') AS payment_failure_count_30d,
  max("timestamp") AS updated_at
FROM {p}touch GROUP BY ALL"""
    PARTS[f"{p}cust"] = f"""
SELECT c.*,
  (SELECT CAST(coalesce(sum(s.mrr_cents), 0) AS BIGINT) FROM {p}subs s WHERE s.tenant_id = c.tenant_id
     AND s.customer_id = c.customer_id AND s.status = 'active') AS total_mrr_cents,
  (SELECT count(*) FROM {p}subs s WHERE s.tenant_id = c.tenant_id
     AND s.customer_id = c.customer_id AND s.status = 'active') AS active_subscriptions,
  (SELECT count(*) FROM {p}subs s WHERE s.tenant_id = c.tenant_id
     AND s.customer_id = c.customer_id) AS subscription_count
FROM {p}plain c"""
    PARTS[f"{p}totals"] = f"""
SELECT b.tenant_id, b.project_id, CAST(coalesce(any_value(c.mrr), 0) AS BIGINT) AS total_mrr_cents,
  coalesce(any_value(c.n), 0) AS total_customers,
  CAST(coalesce(any_value(c.act), 0) AS BIGINT) AS active_subscriptions,
  CAST(coalesce(any_value(c.paid), 0) AS BIGINT) AS total_paid_cents, count(*) AS event_count
FROM {source} b LEFT JOIN (SELECT tenant_id, sum(total_mrr_cents) AS mrr, count(*) AS n,
    sum(active_subscriptions) AS act, sum(total_paid_cents) AS paid FROM {p}cust GROUP BY 1) c USING (tenant_id)
GROUP BY b.tenant_id, b.project_id"""


ledger_parts("", PERIOD_A, PERIOD_B)
ledger_parts("ch_", PERIOD_A, PERIOD_B)

PARTS["disc"] = """
SELECT tenant_id, project_id, customer_id, subscription_id, generation, mrr_cents AS expected_mrr_cents,
       observed AS observed_mrr_cents, mrr_cents - observed AS difference_cents,
       CASE WHEN mrr_cents > observed THEN 'missing_invoice' ELSE 'double_charge' END AS reason
FROM (SELECT s.*, CASE WHEN c.total_paid_cents > 0 THEN least(s.mrr_cents, c.total_paid_cents) ELSE 0 END AS observed
      FROM subs s, cust c
      WHERE s.tenant_id = c.tenant_id AND s.customer_id = c.customer_id AND s.status <> 'canceled')
WHERE abs(mrr_cents - observed) > 100"""


def closure(body: str) -> list[str]:
    """The parts a text needs, in definition order."""
    wanted: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in PARTS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(PARTS[name])
    return [name for name in PARTS if name in wanted]


def sql(body: str) -> str:
    names = closure(body)
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({PARTS[name].strip()}\n)" for name in names)
    return f"WITH {ctes}\n{body.strip()}"
