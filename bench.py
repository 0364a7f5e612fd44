"""Times the headline queries and prints one JSON line.

Every query runs over whole tables and is written to the no-op sink, once to
warm up and then BENCH_RUNS times; its time is the median. Environment:
BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma separated names, 'all' for all).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyline.plans.catalog import all_queries  # noqa: E402
from tallyline.session import local_session  # noqa: E402

HEADLINE = [
    "src_billing_events",
    "ingest_events",
    "ingest_errors",
    "ingest_stats",
    "event_source_hash",
    "ledger_subscriptions",
    "ledger_customers",
    "ledger_totals",
    "recon_discrepancies",
    "recon_summary",
    "anomaly_duplicate_event",
    "anomaly_missing_invoice",
    "anomaly_double_charge",
    "anomaly_refund_spike",
    "anomaly_payment_failure_spike",
    "anomaly_cancel_before_create",
    "anomaly_payment_after_cancel",
    "anomalies_all",
    "anomaly_events",
    "churn_risk_score",
    "churn_ranked",
    "cost_line_items",
    "cost_by_category",
    "cost_snapshot",
    "cost_cache_key",
    "findings_ranked",
    "report_summary",
    "report_markdown_lines",
    "job_requests",
    "profile_effective",
    "redact_typed",
    "redact_hits",
    "redact_payload_keys",
    "runner_metrics_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, shuffle_partitions=cpus)
    queries = all_queries()
    names = HEADLINE if not chosen else list(queries) if chosen == "all" else chosen.split(",")

    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name:34s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "shuffle_partitions": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
