"""Churn risk: five signals per customer, a score, a level and an explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE, days_between, round_half_up
from tallyline.functions.hashing import key_hash
from tallyline.functions.ranking import ranked
from tallyline.functions.skew import salted_join
from tallyline.functions.thresholds import Thresholds, attach

CUSTOMER = [*SCOPE, "customer_id"]
# -- fixed values: limits of the signals --------------------------------------
USAGE_DROP_PCT = 30
MANY_OPEN_TICKETS = 3
RECENT_DAYS = 30
INACTIVE_DAYS = 35
FULLY_INACTIVE_DAYS = 90
SIGNALS = ["payment_failures", "usage_drop", "support_tickets", "plan_downgrade", "no_recent_login"]


def usage_by_customer(usage: DataFrame) -> DataFrame:
    """Row count and the largest drop beyond 30 %; the first in `seq` order wins a tie."""
    previous, current = F.col("previous_value"), F.col("current_value")
    drop = F.when(previous > 0, F.try_divide(previous - current, previous) * 100)
    kept = F.when(F.col("drop_pct") > USAGE_DROP_PCT, F.struct(-F.col("drop_pct"), F.col("seq")))
    return (
        usage.withColumn("drop_pct", drop)
        .groupBy(*CUSTOMER)
        .agg(
            F.count(F.lit(1)).alias("usage_metrics_count"),
            F.min_by(
                F.struct("metric_name", "drop_pct", "previous_value", "current_value", "period_days"), kept
            ).alias("top_drop"),
        )
    )


def tickets_by_customer(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy(*CUSTOMER).agg(
        F.count(F.lit(1)).alias("support_tickets_count"),
        F.count_if(F.col("status").isin("open", "in_progress")).alias("open_tickets"),
        F.count_if(F.col("severity") == "critical").alias("critical_tickets"),
        F.count_if(F.col("severity") == "high").alias("high_tickets"),
    )


def dated(df: DataFrame, name: str, dates: str | DataFrame) -> DataFrame:
    """`df` with a date as ISO text: one for all, or that of each row's tenant (scope and `name`).

    Customers of a tenant without a date are left out.
    """
    if isinstance(dates, str):
        return df.withColumn(name, F.lit(dates))
    return salted_join(df, dates.select(*SCOPE, name), SCOPE, F.col("customer_id"))


def downgrades_by_customer(downgrades: DataFrame, as_of: str | DataFrame) -> DataFrame:
    recent = days_between(F.to_timestamp("as_of"), F.col("changed_at")) <= RECENT_DAYS
    return dated(downgrades, "as_of", as_of).groupBy(*CUSTOMER).agg(
        F.count(F.lit(1)).alias("plan_downgrades_count"),
        F.count_if(recent).alias("recent_downgrades"),
        F.max_by("changed_at", "seq").alias("last_downgrade_at"),
    )


def churn_features(
    customers: DataFrame,
    usage: DataFrame,
    tickets: DataFrame,
    downgrades: DataFrame,
    thresholds: Thresholds | DataFrame,
    reference_date: str | DataFrame,
    as_of: str | DataFrame,
) -> DataFrame:
    """One row per ledger customer with the inputs of every signal and its weight (NULL: no signal).

    The dates are texts, or tables with each tenant's own (scope, `reference_date`;
    scope, `as_of`). Each extra table is aggregated to one row per customer before it is joined.
    """
    counts = ["usage_metrics_count", "support_tickets_count", "plan_downgrades_count", "recent_downgrades"]
    wide = (
        customers.select(
            *CUSTOMER,
            "total_mrr_cents",
            "subscription_count",
            "payment_failure_count_30d",
            "last_payment_at",
        )
        .join(usage_by_customer(usage), CUSTOMER, "left")
        .join(tickets_by_customer(tickets), CUSTOMER, "left")
        .join(downgrades_by_customer(downgrades, as_of), CUSTOMER, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    )
    wide = attach(
        wide,
        thresholds,
        "payment_failure_weight",
        "usage_drop_weight",
        "support_ticket_weight",
        "plan_downgrade_weight",
        "inactivity_weight",
        "risk_score_low_threshold",
        "risk_score_medium_threshold",
        "risk_score_high_threshold",
        spread_by="customer_id",
    )
    failures = F.col("payment_failure_count_30d")
    tickets_n = F.col("support_tickets_count")
    urgency = (
        F.when(F.col("critical_tickets") > 0, 2.0)
        .when(F.col("high_tickets") > 0, 1.5)
        .when(F.col("open_tickets") > MANY_OPEN_TICKETS, 1.3)
        .otherwise(1.0)
    )
    wide = dated(wide, "reference_date", reference_date)
    idle = days_between(F.to_timestamp("reference_date"), F.col("last_payment_at"))
    idle_share = F.when(F.col("idle_days").isNull(), 1.0).otherwise(
        F.least(F.col("idle_days") / FULLY_INACTIVE_DAYS, F.lit(1.0))
    )
    return wide.withColumn("idle_days", idle).withColumns(
        {
            "w_payment_failures": F.when(
                failures > 0,
                F.least(F.col("payment_failure_weight") * F.least(failures * F.lit(0.2), F.lit(2.0)), F.lit(0.9)),
            ),
            "w_usage_drop": F.when(
                F.col("top_drop").isNotNull(),
                F.col("usage_drop_weight") * F.least(F.col("top_drop.drop_pct") / 100, F.lit(1.0)),
            ),
            "w_support_tickets": F.when(
                tickets_n > 0,
                F.least(F.col("support_ticket_weight") * urgency * F.sqrt(tickets_n.cast("double")), F.lit(0.9)),
            ),
            "w_plan_downgrade": F.when(
                F.col("plan_downgrades_count") > 0,
                F.least(
                    F.col("plan_downgrade_weight") * (F.lit(1.0) + F.col("recent_downgrades") * F.lit(0.5)), F.lit(0.8)
                ),
            ),
            "w_no_recent_login": F.when(
                (F.col("total_mrr_cents") != 0)
                & (F.col("idle_days").isNull() | (F.col("idle_days") >= INACTIVE_DAYS)),
                F.col("inactivity_weight") * idle_share,
            ),
        }
    )


def _evidence(signal: str) -> Column:
    text = lambda c: c.cast("string")
    n = lambda name: text(F.col(name))
    if signal == "payment_failures":
        lines = [F.concat(n("payment_failure_count_30d"), F.lit(" payment failure(s) in last 30 days"))]
    elif signal == "usage_drop":
        lines = [
            F.concat(
                F.lit('Usage metric "'),
                F.col("top_drop.metric_name"),
                F.format_string('" dropped %.1f%%', F.col("top_drop.drop_pct")),
            ),
            F.format_string("From %.2f to %.2f", F.col("top_drop.previous_value"), F.col("top_drop.current_value")),
        ]
    elif signal == "support_tickets":
        lines = [
            F.concat(n("support_tickets_count"), F.lit(" support ticket(s), "), n("open_tickets"), F.lit(" open")),
            F.when(F.col("critical_tickets") > 0, F.concat(n("critical_tickets"), F.lit(" critical severity"))),
        ]
    elif signal == "plan_downgrade":
        lines = [
            F.concat(n("plan_downgrades_count"), F.lit(" plan downgrade(s) recorded")),
            F.when(
                F.col("recent_downgrades") > 0,
                F.concat(n("recent_downgrades"), F.lit(" downgrade(s) in last 30 days")),
            ).otherwise("Most recent downgrade >30 days ago"),
        ]
    else:
        lines = [
            F.when(F.col("idle_days").isNull(), "No recorded payment activity").otherwise(
                F.concat(F.lit("No payment in "), text(round_half_up(F.col("idle_days"))), F.lit(" days"))
            )
        ]
    return F.array_compact(F.array(*lines, F.lit(fixed.SIGNAL_NOTES[signal])))


def signal(features: DataFrame, name: str) -> DataFrame:
    """One signal as a table: customer, weight and evidence."""
    return features.where(F.col(f"w_{name}").isNotNull()).select(
        *CUSTOMER, F.lit(name).alias("signal_type"), F.col(f"w_{name}").alias("weight"), _evidence(name).alias("evidence")
    )


def _signal_list() -> Column:
    """The signals of a row, strongest first; equal weights keep the order of SIGNALS."""
    entries = [
        F.when(
            F.col(f"w_{name}").isNotNull(),
            F.struct(
                (-F.col(f"w_{name}")).alias("sort_weight"),
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("signal_type"),
                F.col(f"w_{name}").alias("weight"),
                _evidence(name).alias("evidence"),
            ),
        )
        for i, name in enumerate(SIGNALS)
    ]
    return F.array_sort(F.array_compact(F.array(*entries)))


def churn_risks(features: DataFrame) -> DataFrame:
    """Score, level, explanation and recommended actions per customer, as of the features' reference date."""
    weights = [F.col(f"w_{name}") for name in SIGNALS]
    n_signals = sum((w.isNotNull().cast("int") for w in weights), F.lit(0))
    weighted = F.lit(0.0)
    for w in weights:
        weighted = weighted + F.coalesce(w * 100, F.lit(0.0))
    raw_score = F.least(weighted * (F.lit(1.0) + (F.col("signal_count") - 1) * F.lit(0.1)), F.lit(100.0))
    score = F.when(F.col("signal_count") == 0, F.lit(0).cast("bigint")).otherwise(round_half_up(raw_score))
    level = (
        F.when(F.col("risk_score") >= F.col("risk_score_high_threshold"), "critical")
        .when(F.col("risk_score") >= F.col("risk_score_medium_threshold"), "high")
        .when(F.col("risk_score") >= F.col("risk_score_low_threshold"), "medium")
        .otherwise("low")
    )
    part = lambda s: F.concat(
        F.replace(s["signal_type"], F.lit("_"), F.lit(" ")),
        F.lit(" ("),
        round_half_up(s["weight"] * 100).cast("string"),
        F.lit("% impact)"),
    )
    explanation = F.when(
        F.col("signal_count") == 0,
        F.concat(F.lit("Customer "), "customer_id", F.lit(" shows no significant churn risk signals.")),
    ).otherwise(
        F.concat(
            F.lit("Customer "),
            "customer_id",
            F.lit(" has risk score "),
            F.col("risk_score").cast("string"),
            F.lit("/100 based on: "),
            F.array_join(F.transform("contributing_signals", part), ", "),
            F.lit("."),
        )
    )
    level_action = F.create_map(*[F.lit(x) for kv in fixed.LEVEL_ACTIONS.items() for x in kv])
    signal_action = F.create_map(*[F.lit(x) for kv in fixed.SIGNAL_ACTIONS.items() for x in kv])
    actions = F.array_compact(
        F.concat(
            F.array(F.try_element_at(level_action, F.col("risk_level"))),
            F.transform("contributing_signals", lambda s: F.try_element_at(signal_action, s["signal_type"])),
        )
    )
    signals = F.transform(
        "signal_list",
        lambda s: F.struct(
            s["signal_type"].alias("signal_type"), s["weight"].alias("weight"), s["evidence"].alias("evidence")
        ),
    )
    return (
        features.withColumn("signal_count", n_signals)
        .withColumn("risk_score", score)
        .withColumn("risk_level", level)
        .withColumn("signal_list", _signal_list())
        .withColumn("contributing_signals", signals)
        .select(
            *CUSTOMER,
            F.concat(
                F.lit("churn-"),
                key_hash(F.col("tenant_id"), F.col("project_id"), F.col("customer_id"), F.col("reference_date")),
            ).alias("risk_id"),
            F.col("reference_date").alias("calculated_at"),
            "risk_score",
            "risk_level",
            "signal_count",
            "contributing_signals",
            explanation.alias("explanation"),
            actions.alias("recommended_actions"),
            F.col("total_mrr_cents").alias("mrr_cents"),
            "subscription_count",
            F.col("payment_failure_count_30d").alias("payment_failures_30d"),
            "usage_metrics_count",
            "support_tickets_count",
            "plan_downgrades_count",
            F.lit(fixed.CONTRACT_VERSION).alias("version"),
        )
    )


def rank_risks(risks: DataFrame) -> DataFrame:
    """Highest score first within a tenant, then by customer id, with `risk_rank`."""
    return ranked(risks, SCOPE, [F.col("risk_score").desc(), F.col("customer_id")], "risk_rank")


def churn_stats(risks: DataFrame) -> DataFrame:
    by_level = [F.count_if(F.col("risk_level") == lv).alias(f"{lv}_count") for lv in fixed.SEVERITIES]
    return risks.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("total_assessed"),
        *by_level,
        (F.sum("risk_score") / F.count(F.lit(1))).alias("average_score"),
    )
