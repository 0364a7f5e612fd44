"""Runner metrics: roll-up of a run log per runner and window, and row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.percentiles import nearest_rank
from tallyline.functions.rules import Rule, at_least, not_null, violations

METRIC_KEYS = ["runner_id", "job_type", "window_start", "window_end"]
COUNTS = [
    "success_count",
    "failure_count",
    "retry_count",
    "idempotent_replay_count",
    "input_records",
    "output_records",
    "latency_ms_p50",
    "latency_ms_p95",
]
# -- fixed values: risk flag raised by each job type ---------------------------
RISK_FLAGS = [
    (fixed.JOB_RECONCILE, "unbounded_input", "input_records"),
    (fixed.JOB_ANOMALY_SCAN, "high_anomaly_volume", "output_records"),
    (fixed.JOB_CHURN_RISK, "excessive_retry", "retry_count"),
    (fixed.COST_CAPABILITY, "unbounded_line_items", "output_records"),
]


def rollup(runs: DataFrame, limits: dict[str, int], window: str = "1 day") -> DataFrame:
    """One metric row per runner, job type and window.

    Percentiles are nearest-rank on whole milliseconds, selected over counts.
    """
    runs = runs.withColumn("w", F.window("started_at", window))
    group = ["runner_id", "job_type", "w"]
    latencies = nearest_rank(runs, group, "latency_ms", {"latency_ms_p50": 50, "latency_ms_p95": 95})
    flags = [
        F.when((F.col("job_type") == job) & (F.col(column) > limits[flag]), F.lit(flag))
        for job, flag, column in RISK_FLAGS
    ]
    return (
        runs.groupBy(*group)
        .agg(
            F.count_if("succeeded").alias("success_count"),
            F.count_if(~F.col("succeeded")).alias("failure_count"),
            F.sum("retries").alias("retry_count"),
            F.count_if("is_replay").alias("idempotent_replay_count"),
            F.sum("input_records").alias("input_records"),
            F.sum("output_records").alias("output_records"),
        )
        .join(latencies, group, "left")
        .select(
            "runner_id",
            "job_type",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            F.col("w.end").alias("captured_at"),
            *COUNTS,
        )
        .withColumn("cost_risk_flags", F.array_compact(F.array(*flags)))
    )


def metric_rules() -> list[Rule]:
    names = ["runner_id", "job_type", "window_start", "window_end", "captured_at"]
    return [*[not_null(n) for n in names], *[r for c in COUNTS for r in (not_null(c), at_least(c, 0))]]


def metric_violations(metrics: DataFrame) -> DataFrame:
    key = F.concat_ws("/", "runner_id", "job_type", F.date_format("window_start", "yyyy-MM-dd"))
    return violations(metrics, "runner_metrics", key, metric_rules(), scope=[])


def metrics_report(metrics: DataFrame, generated_at: str, module_id: str = fixed.MODULE_ID) -> DataFrame:
    """Metric rows with the report header on each row."""
    return metrics.select(
        F.lit(module_id).alias("module_id"),
        F.lit(fixed.CONTRACT_VERSION).alias("schema_version"),
        F.lit(generated_at).alias("generated_at"),
        "*",
    )
