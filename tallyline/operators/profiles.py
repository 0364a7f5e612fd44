"""Threshold profiles as a table: lookup, overrides, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.rules import Rule, at_least, between, violations
from tallyline.functions.thresholds import THRESHOLD_FIELDS, Thresholds, field_type

DEFAULT_PROFILE = "base"


def profile(profile_id: str) -> Thresholds:
    """The thresholds of a shipped profile; unknown ids get the base profile."""
    return Thresholds(**fixed.PROFILE_CHANGES.get(profile_id, {}))


def profiles_df(spark: SparkSession) -> DataFrame:
    """The shipped profiles, one row each."""
    rows = [(name, *[getattr(profile(name), f) for f in THRESHOLD_FIELDS]) for name in fixed.PROFILE_CHANGES]
    schema = ", ".join(["profile_id string", *[f"{f} {field_type(f)}" for f in THRESHOLD_FIELDS]])
    return spark.createDataFrame(rows, schema)


def profile_thresholds(tenants: DataFrame) -> DataFrame:
    """Thresholds per tenant from its `profile_id`; unknown or missing ids get the base profile.

    The profile table has one row per shipped profile, so it is broadcast.
    """
    shipped = F.broadcast(profiles_df(tenants.sparkSession))
    base = profile(DEFAULT_PROFILE)
    return tenants.join(shipped, "profile_id", "left").select(
        *tenants.columns,
        *[F.coalesce(F.col(f), F.lit(getattr(base, f)).cast(field_type(f))).alias(f) for f in THRESHOLD_FIELDS],
    )


def effective_profile(tenants: DataFrame) -> DataFrame:
    """Profile thresholds with the tenant's own values (`o_<field>`, NULL: none) on top."""
    overridden = [f for f in THRESHOLD_FIELDS if f"o_{f}" in tenants.columns]
    return profile_thresholds(tenants).select(
        *SCOPE,
        "profile_id",
        *[
            F.coalesce(F.col(f"o_{f}").cast(field_type(f)), F.col(f)).alias(f) if f in overridden else F.col(f)
            for f in THRESHOLD_FIELDS
        ],
    )


def profile_rules() -> list[Rule]:
    weights = [f for f in THRESHOLD_FIELDS if f.endswith("_weight")]
    scores = [f for f in THRESHOLD_FIELDS if f.startswith("risk_score_")]
    return [
        at_least("refund_spike_threshold_cents", 0),
        between("refund_spike_threshold_pct", 0, 100),
        at_least("dispute_spike_threshold", 0),
        between("payment_failure_spike_threshold", 0, 1),
        at_least("duplicate_event_window_seconds", 0),
        between("usage_drop_threshold_pct", 0, 100),
        *[between(f, 0, 1) for f in weights],
        *[between(f, 0, 100) for f in scores],
    ]


def profile_violations(effective: DataFrame) -> DataFrame:
    return violations(effective, "profiles", F.col("profile_id"), profile_rules())


def threshold(chosen: Thresholds | None, name: str, fallback: float = 0) -> float:
    """One threshold of a profile, or the fallback where the name or the profile is missing."""
    return getattr(chosen, name, fallback)


def exceeds(value: Column, limit: Column) -> Column:
    """Strictly above the limit."""
    return value > limit
