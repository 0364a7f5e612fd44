"""Ingest: raw JSON events to checked, normalised billing events.

Input is a table with `raw` (the JSON text of one event), the tenant columns
the caller vouches for, and `ingest_seq`. Fields are read as VARIANT so that a
missing field, a JSON null and a value of the wrong type stay distinguishable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE
from tallyline.functions.hashing import sha256_hex, source_hash
from tallyline.functions.rules import Rule, broken_rules, matches

TEXT_FIELDS = ["event_id", "event_type", "timestamp", "customer_id"]
OPTIONAL_TEXT_FIELDS = ["subscription_id", "invoice_id", "currency", "plan_id", "period_start", "period_end"]
PLAIN_FIELDS = [*TEXT_FIELDS, "subscription_id", "invoice_id", "amount_cents", "currency", "plan_id"]
EVENT_COLUMNS = [
    *SCOPE,
    "event_id",
    "event_type",
    "timestamp",
    "timestamp_text",
    "customer_id",
    "subscription_id",
    "invoice_id",
    "amount_cents",
    "currency",
    "plan_id",
    "period_start",
    "period_end",
    "metadata",
    "raw_payload",
    "normalized_at",
    "source_hash",
    "validation_errors",
    "ingest_seq",
]


def _raw_field(name: str) -> Column:
    return F.try_variant_get(F.col("payload"), f"$.{name}", "variant")


def _type_of(name: str) -> Column:
    return F.schema_of_variant(F.col(f"v_{name}"))


def _text(name: str) -> Column:
    """The field where it is a JSON string, else NULL."""
    return F.when(F.col(f"t_{name}") == "STRING", F.try_variant_get(F.col(f"v_{name}"), "$", "string"))


def _text_rules(name: str, required: bool = False, non_empty: bool = False, pattern: str | None = None) -> list[Rule]:
    kind, value = F.col(f"t_{name}"), F.col(f"s_{name}")
    rules = [Rule(name, "required", kind.isNull())] if required else []
    rules.append(Rule(name, "expected string", kind != "STRING"))
    if non_empty:
        rules.append(Rule(name, "too short", value == ""))
    if pattern is not None:
        rules.append(Rule(name, "invalid format", ~value.rlike(pattern)))
    return rules


def _time_rules(name: str, required: bool = False) -> list[Rule]:
    value = F.col(f"s_{name}")
    wrong = ~value.rlike(fixed.TIMESTAMP_PATTERN) | F.try_to_timestamp(value).isNull()
    return [*_text_rules(name, required), Rule(name, "invalid format", value.isNotNull() & wrong)]


def event_rules() -> list[Rule]:
    """The field rules of a billing event, in contract order."""
    amount_type, amount = F.col("t_amount_cents"), F.col("amount_number")
    is_number = amount_type.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return [
        Rule("tenant_id", "too short", F.col("tenant_id") == ""),
        matches("tenant_id", fixed.TENANT_PATTERN),
        Rule("project_id", "too short", F.col("project_id") == ""),
        matches("project_id", fixed.PROJECT_PATTERN),
        *_text_rules("event_id", required=True, non_empty=True),
        *_text_rules("event_type", required=True),
        Rule("event_type", "not in enumeration", ~F.col("s_event_type").isin(fixed.EVENT_TYPES)),
        *_time_rules("timestamp", required=True),
        *_text_rules("customer_id", required=True, non_empty=True),
        *_text_rules("subscription_id", non_empty=True),
        *_text_rules("invoice_id", non_empty=True),
        Rule("amount_cents", "expected number", ~is_number),
        Rule("amount_cents", "not an integer", is_number & (amount != F.floor(amount))),
        *_text_rules("currency", pattern=fixed.CURRENCY_PATTERN),
        *_text_rules("plan_id"),
        *_time_rules("period_start"),
        *_time_rules("period_end"),
        Rule("metadata", "expected object", ~F.col("t_metadata").startswith("OBJECT") & (F.col("t_metadata") != "VOID")),
        Rule("raw_payload", "expected object", F.col("raw_kind") == "array"),
    ]


def check(raw: DataFrame) -> DataFrame:
    """Raw rows with their parsed fields and `messages`, the rules they break.

    `raw_kind` is 'object', 'array', 'scalar', 'malformed', or 'file' for a file the reader rejects.
    """
    file_error = F.col("file_error") if "file_error" in raw.columns else F.lit(None).cast("string")
    opening = F.substring(F.ltrim(F.col("raw")), 1, 1)
    kind = (
        F.when(F.col("file_error").isNotNull(), "file")
        .when(F.col("payload").isNull(), "malformed")
        .when(opening == "{", "object")
        .when(opening == "[", "array")
        .otherwise("scalar")
    )
    names = [*TEXT_FIELDS, *OPTIONAL_TEXT_FIELDS, "amount_cents", "metadata"]
    texts = [*TEXT_FIELDS, *OPTIONAL_TEXT_FIELDS]
    parsed = (
        raw.select(*SCOPE, "ingest_seq", "raw", file_error.alias("file_error"))
        .withColumn("payload", F.try_parse_json("raw"))
        .withColumn("raw_kind", kind)
        .withColumns({f"v_{n}": _raw_field(n) for n in names})
        .withColumns({f"t_{n}": _type_of(n) for n in names})
        .withColumns({f"s_{n}": _text(n) for n in texts})
        .withColumn("amount_number", F.try_variant_get(F.col("v_amount_cents"), "$", "double"))
    )
    rules = event_rules()
    is_json = F.col("raw_kind").isin("object", "array")
    # most rows are valid: one flag settles that before any message is built
    suspect = parsed.withColumn("suspect", reduce(lambda x, y: x | y, [F.coalesce(r.broken, F.lit(False)) for r in rules]))
    messages = (
        F.when(F.col("raw_kind") == "file", F.array("file_error"))
        .when(F.col("raw_kind") == "malformed", F.array(F.lit("Event must be valid JSON")))
        .when(F.col("raw_kind") == "scalar", F.array(F.lit("Event must be an object")))
        .when(F.col("suspect"), broken_rules(rules))
        .otherwise(F.array().cast("array<string>"))
    )
    # what lenient mode hashes for a rejected row: the fields as they were given
    as_given = F.to_json(F.struct(*SCOPE, *[F.col(f"v_{n}").alias(n) for n in PLAIN_FIELDS]))
    whole = F.col("amount_number") == F.floor("amount_number")
    no_metadata = F.coalesce(F.col("t_metadata"), F.lit("VOID")) == "VOID"
    checked = suspect.select(
        *SCOPE,
        "ingest_seq",
        "raw",
        F.col("raw_kind").alias("kind"),
        "payload",
        *[f"s_{n}" for n in texts],
        F.when(whole, F.try_variant_get(F.col("v_amount_cents"), "$", "bigint")).alias("amount_cents"),
        F.when(no_metadata, F.parse_json(F.lit("{}"))).otherwise(F.col("v_metadata")).alias("metadata"),
        F.when(F.col("suspect") & is_json, sha256_hex(as_given)).alias("given_hash"),
        messages.alias("broken"),
    )
    # a generator of one row: filters on `messages` and `raw_kind` stay above it, so the text is built and parsed
    # and the rules run once per row; the other columns don't pass through it, and those that nobody reads are not computed
    judged = F.struct(F.col("kind").alias("raw_kind"), F.col("broken").alias("messages"))
    return checked.select("*", F.inline(F.array(judged))).drop("kind", "broken")


def _normalised(checked: DataFrame, normalized_at: str) -> DataFrame:
    typed = checked.select(
        *SCOPE,
        *[F.col(f"s_{n}").alias(n) for n in ["event_id", "event_type", "customer_id", "subscription_id", "invoice_id"]],
        F.try_to_timestamp("s_timestamp").alias("timestamp"),
        F.col("s_timestamp").alias("timestamp_text"),
        "amount_cents",
        F.col("s_currency").alias("currency"),
        F.col("s_plan_id").alias("plan_id"),
        F.try_to_timestamp("s_period_start").alias("period_start"),
        F.try_to_timestamp("s_period_end").alias("period_end"),
        "metadata",
        F.col("payload").alias("raw_payload"),
        F.to_timestamp(F.lit(normalized_at)).alias("normalized_at"),
        F.col("messages").alias("validation_errors"),
        "ingest_seq",
        "given_hash",
    )
    return typed.withColumn("source_hash", F.coalesce("given_hash", source_hash())).select(*EVENT_COLUMNS)


def events_of(checked: DataFrame, normalized_at: str, lenient: bool = False) -> DataFrame:
    """Valid events; in lenient mode also the objects and arrays that break rules."""
    valid = F.size("messages") == 0
    kept = F.col("raw_kind").isin("object", "array") if lenient else valid
    return _normalised(checked.where(kept), normalized_at)


def errors_of(checked: DataFrame) -> DataFrame:
    """Rejected rows with their messages as one text."""
    return checked.where(F.size("messages") > 0).select(
        *SCOPE, "ingest_seq", "raw", F.array_join("messages", ", ").alias("error")
    )


def ingest(raw: DataFrame, normalized_at: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of a raw table. Lenient: rows with broken rules are in both."""
    checked = check(raw)
    return events_of(checked, normalized_at, lenient), errors_of(checked)


def ingest_stats(checked: DataFrame, lenient: bool = False) -> DataFrame:
    """Rows given, kept and rejected per tenant."""
    rejected = F.size("messages") > 0
    kept = F.col("raw_kind").isin("object", "array") if lenient else ~rejected
    return checked.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("valid"), F.count_if(rejected).alias("invalid")
    )


def ingest_stats_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy(*SCOPE, "event_type").agg(F.count(F.lit(1)).alias("event_count"))


def first_errors(errors: DataFrame, k: int) -> DataFrame:
    """The first k rejected rows of each tenant; each task passes on at most k per tenant."""
    place = Window.partitionBy(*SCOPE).orderBy("ingest_seq", "error")
    kept = errors.withColumn("position", F.row_number().over(place)).where(F.col("position") <= k)
    return kept.withColumn("position", F.col("position").cast("bigint"))
