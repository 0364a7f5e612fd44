"""Billing data derived from the generic `events` and `orders` tables.

The test tables hold no billing events. These views map them, row by row and
over the whole tables, to billing events, churn inputs, raw JSON with planted
faults, run logs and text with planted secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.columns import iso_micros
from tallyline.functions.ordered import ordered_scan
from tallyline.functions.skew import HeavyKeys

PERIOD_START = "2024-01-03T00:00:00Z"
PERIOD_END = "2024-01-28T23:59:59.999Z"
REFERENCE_DATE = "2024-02-20T00:00:00Z"
CHURN_REFERENCE_DATE = "2024-02-28T00:00:00Z"
REDELIVERY_SEQ = 1_000_000_000
DOUBLE_CHARGE_SEQ = 2_000_000_000
MAX_SHIFT_SECONDS = 600


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_type(raw: Column, k: Column) -> Column:
    signup = (
        F.when(k % 4 == 0, "subscription_cancelled")
        .when(k % 4 == 1, "subscription_updated")
        .otherwise("subscription_created")
    )
    purchase = (
        F.when(k % 10 == 0, "invoice_refunded")
        .when(k % 10 == 1, "invoice_disputed")
        .when(k % 10 == 2, "dispute_lost")
        .when(k % 10 == 3, "refund_issued")
        .otherwise("invoice_paid")
    )
    error = F.when(k % 5 == 0, "invoice_failed").when(k % 5 == 1, "dispute_created").otherwise("payment_failed")
    click = F.when(k % 2 == 0, "payment_succeeded").when(k % 25 == 1, "dispute_won").otherwise("usage_recorded")
    return (
        F.when(raw == "signup", signup)
        .when(raw == "purchase", purchase)
        .when(raw == "error", error)
        .when(raw == "click", click)
        .when(raw == "view", "usage_recorded")
    )


def billing_view(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Billing events with re-deliveries and double charges, in one scan of `events`.

    `since`/`until` are pushed to the scan as a time range wide enough for every
    row whose (possibly shifted) timestamp lies in it; the exact cut is left to
    the operators.
    """
    if since is not None:
        events = events.where(
            F.col("ts") >= F.to_timestamp(F.lit(since)) - F.expr(f"interval {MAX_SHIFT_SECONDS} seconds")
        )
    if until is not None:
        events = events.where(F.col("ts") <= F.to_timestamp(F.lit(until)))

    e, u, k = F.col("e"), F.col("u"), F.col("k")
    kind = F.col("event_type")
    base = events.select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("u"),
        F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int").alias("k"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("raw_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    ).withColumn("event_type", _event_type(F.col("raw_type"), k))

    is_subscription = kind.startswith("subscription_")
    typed = base.select(
        "e",
        "ts",
        "event_type",
        F.concat(F.lit("tenant-"), (u % 3).cast("string")).alias("tenant_id"),
        F.lit("project-main").alias("project_id"),
        F.concat(F.lit("cus_"), u.cast("string")).alias("customer_id"),
        F.when(
            is_subscription | (k % 7 != 0),
            F.concat(F.lit("sub_"), u.cast("string"), F.lit("_"), (e % 3).cast("string")),
        ).alias("subscription_id"),
        F.when(
            kind.startswith("invoice_") | kind.startswith("refund_") | kind.startswith("dispute_"),
            F.concat(F.lit("inv_"), e.cast("string")),
        ).alias("invoice_id"),
        F.when(
            ~(
                kind.isin("subscription_cancelled", "payment_failed")
                | ((kind == "subscription_updated") & (k % 3 == 0))
            ),
            F.col("cents"),
        ).alias("amount_cents"),
        F.when((u % 3 == 2) & (k % 50 == 0), "EUR").otherwise("USD").alias("currency"),
        F.when(
            kind.isin("subscription_created", "subscription_updated") & (k % 3 != 1),
            F.concat(F.lit("plan_"), (k % 5).cast("string")),
        ).alias("plan_id"),
    )

    copy = lambda suffix, seconds, seq: F.struct(
        F.lit(suffix).alias("suffix"), seconds.cast("int").alias("seconds"), (e + F.lit(seq)).alias("ingest_seq")
    )
    copies = F.array(
        copy("", F.lit(0), 0),
        F.when(e % 97 == 0, copy("", e % 600, REDELIVERY_SEQ)),
        F.when((kind == "invoice_paid") & (e % 23 == 0), copy("_dc", F.lit(120), DOUBLE_CHARGE_SEQ)),
    )
    return (
        typed.select("*", F.inline(copies))
        .where(F.col("suffix").isNotNull())  # a filter on rows is compiled, one on the array's entries is not
        .withColumn("timestamp", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("seconds")))
        .select(
            "tenant_id",
            "project_id",
            F.concat(F.lit("evt_"), F.col("e").cast("string"), F.col("suffix")).alias("event_id"),
            "event_type",
            "timestamp",
            iso_micros(F.col("timestamp")).alias("timestamp_text"),
            "customer_id",
            "subscription_id",
            "invoice_id",
            "amount_cents",
            "currency",
            "plan_id",
            F.lit(None).cast("timestamp").alias("period_start"),
            F.lit(None).cast("timestamp").alias("period_end"),
            "ingest_seq",
        )
    )


def given_periods(tenants: DataFrame) -> DataFrame:
    """Analysis periods as tenants ask for them; what is null is to come from their events."""

    def of(values: dict[str, str]):
        pairs = [F.lit(x) for kv in values.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), F.col("tenant_id"))

    return tenants.select(
        "tenant_id",
        "project_id",
        of({"tenant-0": "2024-01-05T00:00:00Z"}).alias("period_start"),
        of({"tenant-0": "2024-01-20T23:59:59.999Z", "tenant-1": "2024-01-25T12:00:00Z"}).alias("period_end"),
        of({"tenant-1": "2024-02-10T00:00:00Z"}).alias("reference_date"),
    )


def usage_metrics(events: DataFrame) -> DataFrame:
    """Rows per user and event type before and after mid-January, as usage values."""
    split = F.to_timestamp(F.lit("2024-01-16T00:00:00Z"))
    ts = F.col("ts").cast("timestamp")
    return (
        events.groupBy("user_id", "event_type")
        .agg(
            F.count_if(ts >= split).cast("double").alias("current_value"),
            F.count_if(ts < split).cast("double").alias("previous_value"),
        )
        .select(
            F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
            F.lit("project-main").alias("project_id"),
            F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_id"),
            F.col("event_type").alias("metric_name"),
            "current_value",
            "previous_value",
            F.lit(15).alias("period_days"),
            F.col("event_type").alias("seq"),
        )
    )


def support_tickets(orders: DataFrame) -> DataFrame:
    """Every order as a support ticket of its customer; customers without events stay unknown."""
    first = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.concat(F.lit("tick_"), F.col("o_orderkey").cast("string")).alias("ticket_id"),
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"),
        F.lit("project-main").alias("project_id"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").otherwise("low").alias(
            "severity"
        ),
        F.when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .otherwise("resolved")
        .alias("status"),
        F.lit("billing").alias("category"),
    )


def plan_downgrades(billing: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Every plan change to a smaller plan id."""
    key = ["tenant_id", "project_id", "subscription_id"]
    planned = billing.where(F.col("plan_id").isNotNull() & F.col("subscription_id").isNotNull())
    planned = planned.select(*key, "customer_id", "plan_id", "timestamp", "event_id", "ingest_seq")
    heavy = HeavyKeys(billing).of(key) if heavy is None else heavy.of(key)
    return (
        ordered_scan(
            planned, key, ["timestamp", "event_id", "ingest_seq"], previous={"from_plan": "plan_id"}, heavy=heavy
        )
        .where(F.col("plan_id") < F.col("from_plan"))
        .select(
            "tenant_id",
            "project_id",
            "customer_id",
            "from_plan",
            F.col("plan_id").alias("to_plan"),
            F.col("timestamp").alias("changed_at"),
            F.col("ingest_seq").alias("seq"),
        )
    )


def raw_billing(billing: DataFrame) -> DataFrame:
    """The billing view as JSON text per event, with faults planted by event number."""
    number = F.regexp_extract("event_id", r"(\d+)", 1).cast("bigint")
    fault = number % 101
    quoted = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    is_fault = lambda *codes: fault.isin(*codes)
    body = F.concat_ws(
        ",",
        F.when(is_fault(12), F.lit('"tenant_id":"somebody-else"')),
        quoted("event_id", F.when(is_fault(4), "").otherwise(F.col("event_id"))),
        quoted("event_type", F.when(is_fault(5), "foo").otherwise(F.col("event_type"))),
        quoted(
            "timestamp",
            F.when(is_fault(6), F.regexp_replace("timestamp_text", "Z$", "+02:00")).otherwise(F.col("timestamp_text")),
        ),
        F.when(~is_fault(3, 13), quoted("customer_id", F.col("customer_id"))),
        F.when(is_fault(10), F.lit('"subscription_id":null')).otherwise(
            quoted("subscription_id", F.col("subscription_id"))
        ),
        quoted("invoice_id", F.col("invoice_id")),
        F.concat(
            F.lit('"amount_cents":'),
            F.when(is_fault(7), "12.5").when(is_fault(8), "5000.0").otherwise(F.col("amount_cents").cast("string")),
        ),
        quoted("currency", F.when(is_fault(9, 13), "usd").otherwise(F.col("currency"))),
        quoted("plan_id", F.col("plan_id")),
        F.when(is_fault(11), F.lit('"extra":1,"metadata":null')),
    )
    text = (
        F.when(is_fault(1), F.lit("42"))
        .when(is_fault(2), F.concat(F.lit("["), number.cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    )
    return billing.select("tenant_id", "project_id", "ingest_seq", text.alias("raw"))


def ledger_fragments(customers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Ledger documents as JSON text, one per subscription, so that no document grows with its customer."""
    text = lambda c: iso_micros(F.col(c)).alias(c)
    subscription = F.struct(
        "subscription_id",
        "customer_id",
        "plan_id",
        "status",
        text("current_period_start"),
        text("current_period_end"),
        "mrr_cents",
        "currency",
        text("created_at"),
        text("canceled_at"),
        "cancel_at_period_end",
    )
    rows = subscriptions.join(
        customers.select("tenant_id", "project_id", "customer_id", "total_paid_cents"),
        ["tenant_id", "project_id", "customer_id"],
    )
    customer = F.struct(
        "customer_id", "tenant_id", "project_id", F.array(subscription).alias("subscriptions"), "total_paid_cents"
    )
    document = F.struct("tenant_id", "project_id", F.create_map("customer_id", customer).alias("customers"))
    return rows.select(F.to_json(document).alias("document"))


def customer_tenants(customer: DataFrame) -> DataFrame:
    """Every row of `customer` as a tenant with a profile, overrides and job inputs."""
    key = F.col("c_custkey")
    name = key.cast("string")
    path = lambda kind, suffix: F.concat(F.lit(f"./input/{kind}-"), name, F.lit(suffix))
    profiles = ["base", "jobforge", "settler", "readylayer", "aias", "keys", "no-such-profile"]
    names = F.array(*[F.lit(p) for p in profiles])
    return customer.select(
        F.concat(F.lit("cust-"), name).alias("tenant_id"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("project_id"),
        key.alias("number"),
        F.element_at(names, (F.col("c_nationkey") % 7 + 1).cast("int")).alias("profile_id"),
        F.when(key % 4 == 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("o_refund_spike_threshold_cents"),
        F.when(key % 5 == 0, F.col("c_acctbal") / 5000).alias("o_payment_failure_spike_threshold"),
        F.when(key % 6 == 0, (key % 20).cast("bigint")).alias("o_dispute_spike_threshold"),
        F.when(key % 9 == 0, F.col("c_acctbal") / 80).alias("o_risk_score_high_threshold"),
        F.lit(PERIOD_START).alias("period_start"),
        F.lit(PERIOD_END).alias("period_end"),
        F.concat(F.lit("trace-"), name).alias("trace_id"),
        F.when(key % 4 != 1, path("events", ".json")).alias("reconcile_events_path"),
        F.when(key % 4 != 2, path("ledger", ".json")).alias("anomaly_ledger_path"),
        F.when(key % 4 != 3, path("ledger", ".json")).alias("churn_ledger_path"),
        F.when(key % 2 == 0, path("usage", ".json")).alias("usage_metrics_path"),
        F.when(key % 3 == 0, path("tickets", ".json")).alias("support_tickets_path"),
    )


def broken_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, bundles): every request in a bundle of its own, seven of eight with a planted fault."""
    fault = F.regexp_extract("tenant_id", r"(\d+)", 1).cast("bigint") % 8
    action = F.concat(
        F.lit('{"action":"refund",'), F.substring(F.col("payload"), F.lit(2), F.length("payload"))
    )
    bundle_id = F.concat(F.lit("bundle-"), "job_id")
    broken = requests.select(
        bundle_id.alias("bundle_id"),
        "job_id",
        F.when(fault == 7, "autopilot.finops.unknown").otherwise(F.col("job_type")).alias("job_type"),
        F.when(fault == 1, F.lit(None)).when(fault == 6, "somebody-else").otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.when(fault == 2, F.lit(None)).otherwise(F.col("project_id")).alias("project_id"),
        F.when(fault == 4, "").otherwise(F.col("idempotency_key")).alias("idempotency_key"),
        F.when(fault == 5, action).otherwise(F.col("payload")).alias("payload"),
        "metadata",
    )
    bundles = requests.select(
        bundle_id.alias("bundle_id"),
        F.when(fault == 3, "9.9.9").otherwise("1.0.0").alias("schema_version"),
        "tenant_id",
        "project_id",
    )
    return broken, bundles


def run_log(events: DataFrame) -> DataFrame:
    """Every event as a finished run of one of four runners."""
    number = F.col("user_id") % 4
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint")
    jobs = [
        "autopilot.finops.reconcile",
        "autopilot.finops.anomaly_scan",
        "autopilot.finops.churn_risk_report",
        "finops.cost_snapshot",
    ]
    return events.select(
        F.concat(F.lit("runner-"), number.cast("string")).alias("runner_id"),
        F.element_at(F.array(*[F.lit(j) for j in jobs]), (number + 1).cast("int")).alias("job_type"),
        F.col("ts").cast("timestamp").alias("started_at"),
        (F.col("event_type") != "error").alias("succeeded"),
        F.when(k % 10 == 0, 2).when(k % 10 == 1, 1).otherwise(0).cast("bigint").alias("retries"),
        (F.col("event_id") % 97 == 0).alias("is_replay"),
        F.round(F.col("value") * 100).cast("bigint").alias("input_records"),
        k.alias("output_records"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
    )


def planted_secrets(documents: DataFrame) -> DataFrame:
    """Documents with a made-up secret appended by document number; built from parts, whole texts kept."""
    digits = "0123456789"
    letters = "abcdefghijklmnopqrst"
    planted = {
        1: "AKIA" + "ABCDEFGH" + "IJKLMNOP",
        2: "sk-" + letters + digits + "ab",
        3: "sk_" + "live_" + letters + digits,
        4: "ghp_" + letters + digits + "abcdef",
        5: "-----BEGIN RSA " + "PRIVATE KEY-----",
        6: "my_api_key" + "=" + letters,
        7: "my_auth_token" + ": " + letters,
        8: "my_client_secret" + "='" + letters + "'",
    }
    column = F.lit("")
    for i, secret in planted.items():
        column = F.when(F.col("doc_id") % 10 == i, F.lit(" " + secret)).otherwise(column)
    return documents.select("doc_id", F.concat("text", column).alias("text"))


def event_payloads(events: DataFrame) -> DataFrame:
    """Events as free JSON payloads with sensitive keys and values at several depths."""
    user = F.col("user_id").cast("string")
    text = F.concat(
        F.lit('{"event":'),
        F.col("event_id").cast("string"),
        F.lit(',"API_KEY":"'),
        user,
        F.lit('","nested":{"userPassword":{"deep":1},"kind":"'),
        "event_type",
        F.lit('","list":["plain",'),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"user'), user, F.lit('@example.com"'))).otherwise(
            F.lit('"nobody"')
        ),
        F.lit(']},"tokens":['),
        user,
        F.lit("]}"),
    )
    return events.select("event_id", text.alias("payload"))


def typed_secrets(events: DataFrame) -> DataFrame:
    """Events as typed rows with values under sensitive names; every fifth payload is cut off."""
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    login = F.struct(user.alias("password"), F.col("event_type").alias("kind"))
    payload = F.concat(F.lit('{"n":'), number, F.lit(',"token":"'), user, F.lit('"}'))
    return events.select(
        "event_id",
        F.create_map(F.lit("auth_token"), "user_id", F.lit("n"), "event_id").alias("counts"),
        login.alias("login"),
        F.array(F.struct(user.alias("secret"), F.col("event_id").alias("n"))).alias("lists"),
        F.parse_json(F.concat(F.lit('{"a":{"password":'), user, F.lit('},"n":'), number, F.lit("}"))).alias("free"),
        user.alias("api_key"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"token":"'), user))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"n": '), number, F.lit("}")))
        .otherwise(payload)
        .alias("payload"),
    )
