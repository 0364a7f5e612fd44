"""Thresholds as columns: the same for everybody, or one row per tenant."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.skew import salted_join


@dataclass(frozen=True)
class Thresholds:
    """Anomaly and churn thresholds; the defaults are those of the base profile."""

    refund_spike_threshold_cents: int = fixed.ANOMALY_DEFAULTS["refund_spike_threshold_cents"]
    refund_spike_threshold_pct: float = fixed.ANOMALY_DEFAULTS["refund_spike_threshold_pct"]
    dispute_spike_threshold: int = fixed.ANOMALY_DEFAULTS["dispute_spike_threshold"]
    payment_failure_spike_threshold: float = fixed.ANOMALY_DEFAULTS["payment_failure_spike_threshold"]
    duplicate_event_window_seconds: int = fixed.ANOMALY_DEFAULTS["duplicate_event_window_seconds"]
    usage_drop_threshold_pct: float = fixed.ANOMALY_DEFAULTS["usage_drop_threshold_pct"]
    payment_failure_weight: float = fixed.CHURN_DEFAULTS["payment_failure_weight"]
    usage_drop_weight: float = fixed.CHURN_DEFAULTS["usage_drop_weight"]
    support_ticket_weight: float = fixed.CHURN_DEFAULTS["support_ticket_weight"]
    plan_downgrade_weight: float = fixed.CHURN_DEFAULTS["plan_downgrade_weight"]
    inactivity_weight: float = fixed.CHURN_DEFAULTS["inactivity_weight"]
    risk_score_low_threshold: float = fixed.CHURN_DEFAULTS["risk_score_low_threshold"]
    risk_score_medium_threshold: float = fixed.CHURN_DEFAULTS["risk_score_medium_threshold"]
    risk_score_high_threshold: float = fixed.CHURN_DEFAULTS["risk_score_high_threshold"]


INTEGER_FIELDS = [
    "refund_spike_threshold_cents",
    "dispute_spike_threshold",
    "duplicate_event_window_seconds",
]
THRESHOLD_FIELDS = [f.name for f in fields(Thresholds)]


def field_type(name: str) -> str:
    return "bigint" if name in INTEGER_FIELDS else "double"


def literal(thresholds: Thresholds, name: str) -> Column:
    return F.lit(getattr(thresholds, name)).cast(field_type(name))


def attach(
    df: DataFrame, thresholds: Thresholds | DataFrame, *names: str, spread_by: str | None = None
) -> DataFrame:
    """Add threshold columns: literals, or joined on the tenant with base values for unlisted tenants.

    `spread_by` names a column that varies within a tenant; a table with many
    rows per tenant is then joined in slices of each tenant.
    """
    if isinstance(thresholds, Thresholds):
        return df.withColumns({n: literal(thresholds, n) for n in names})
    base, own = Thresholds(), thresholds.select(*SCOPE, *names)
    joined = (
        df.join(own, SCOPE, "left")
        if spread_by is None
        else salted_join(df, own, SCOPE, F.col(spread_by), "left")
    )
    return joined.withColumns({n: F.coalesce(F.col(n), literal(base, n)) for n in names})
