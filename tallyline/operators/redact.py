"""Redaction sweeps over text columns and JSON payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline import fixed
from tallyline.functions.hashing import fold_regex

STYLES = {
    "typed": fixed.TYPED_PATTERNS,
    "inline": fixed.INLINE_PATTERNS,
    "list": fixed.PATTERN_LIST,
}
# a lower-case text that every match of the pattern contains
NEEDLES = {
    fixed.ASSIGNED_KEY: "_key",
    fixed.ASSIGNED_TOKEN: "_token",
    fixed.ASSIGNED_SECRET: "_secret",
    fixed.SK_KEY: "sk-",
    fixed.EMAIL: "@",
    fixed.CLOUD_KEY_ID: "akia",
    fixed.PEM_HEADER: "private key-----",
    fixed.LIVE_PAYMENT_KEY: "sk_live_",
    fixed.ACCESS_TOKEN: "ghp_",
}


def redact_text(text: Column, style: str, extra: list[tuple[str, str, str]] | None = None) -> Column:
    """Replace every match of the style's patterns, one pattern after the other."""
    return fold_regex(text, [*STYLES[style], *(extra or [])], NEEDLES)


def is_sensitive(text: Column) -> Column:
    """True where any whole-value pattern occurs anywhere in the text."""
    hit = F.lit(False)
    for pattern in fixed.WHOLE_VALUE_PATTERNS:
        hit = hit | (F.contains(F.lower(text), F.lit(NEEDLES[pattern])) & text.rlike(pattern))
    return hit


def redact_whole(text: Column) -> Column:
    return F.when(is_sensitive(text), fixed.REDACTED).otherwise(text)


def redact_columns(
    df: DataFrame, columns: list[str], style: str, extra: list[tuple[str, str, str]] | None = None
) -> DataFrame:
    """`df` with the text columns redacted; `style` is typed, inline, list or whole.

    `extra` patterns (name, pattern, replacement) follow those of the style.
    """
    one = redact_whole if style == "whole" else (lambda c: redact_text(c, style, extra))
    return df.withColumns({c: one(F.col(c)) for c in columns})


def redact_hits(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """How often each typed pattern matches a text, counted on the text the earlier patterns left."""
    counts, text = [], F.col(column)
    for name, pattern, replacement in fixed.TYPED_PATTERNS:
        possible = F.contains(F.lower(text), F.lit(NEEDLES[pattern]))
        found = F.when(possible, F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))
        counts.append(found.cast("bigint").alias(name))
        text = fold_regex(text, [(name, pattern, replacement)], NEEDLES)
    names = [name for name, _, _ in fixed.TYPED_PATTERNS]
    return (
        df.select(*key, *counts)
        .unpivot(key, names, "pattern", "hits")
        .where(F.col("hits") > 0)
    )


def is_sensitive_key(name: str) -> bool:
    lower = name.lower()
    return any(word in lower for word in fixed.SENSITIVE_KEY_WORDS)


def redact_typed_column(column: Column, data_type: T.DataType) -> Column:
    """Redact a typed value by the names in its schema; decided while planning.

    Values under a sensitive name are masked whatever their type, so maps of other
    values than text become maps of text (nested values as JSON). Free JSON goes
    the way of payloads; a list or map with free JSON inside becomes free JSON.
    """
    if _inside_list(data_type):
        return F.parse_json(redact_payloads(F.to_json(column)))
    if isinstance(data_type, T.StringType):
        return redact_whole(column)
    if isinstance(data_type, T.StructType):
        return F.when(
            column.isNotNull(),
            F.struct(
                *[
                    (
                        F.lit(fixed.REDACTED)
                        if is_sensitive_key(f.name)
                        else redact_typed_column(column[f.name], f.dataType)
                    ).alias(f.name)
                    for f in data_type.fields
                ]
            ),
        )
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda x: redact_typed_column(x, data_type.elementType))
    if isinstance(data_type, T.VariantType):
        return F.parse_json(redact_payloads(F.to_json(column)))
    if isinstance(data_type, T.MapType):
        value_type = data_type.valueType

        def shown(value: Column) -> Column:
            redacted = redact_typed_column(value, value_type)
            if isinstance(value_type, T.StringType):
                return redacted
            nested = isinstance(value_type, T.StructType | T.ArrayType | T.MapType)
            return F.to_json(redacted) if nested else redacted.cast("string")

        masked = F.lit(fixed.REDACTED)
        if not isinstance(data_type.keyType, T.StringType):
            return F.transform_values(column, lambda k, v: shown(v))
        return F.transform_values(
            column, lambda k, v: F.when(_any_word(F.lower(k), F.lit(False)), masked).otherwise(shown(v))
        )
    return column


def _inside_list(data_type: T.DataType, inside: bool = False) -> bool:
    """Does a list or map hold free JSON? Expressions that walk lists can't call the payload masking."""
    if isinstance(data_type, T.VariantType):
        return inside
    if isinstance(data_type, T.ArrayType):
        return _inside_list(data_type.elementType, True)
    if isinstance(data_type, T.MapType):
        return _inside_list(data_type.valueType, True)
    if isinstance(data_type, T.StructType):
        return any(_inside_list(f.dataType, inside) for f in data_type.fields)
    return False


def _any_word(text: Column, hit: Column) -> Column:
    for word in fixed.SENSITIVE_KEY_WORDS:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def redact_row(df: DataFrame) -> DataFrame:
    """Redact all columns of a typed table by column and field name."""
    return df.select(
        *[
            (F.lit(fixed.REDACTED) if is_sensitive_key(f.name) else redact_typed_column(F.col(f.name), f.dataType)).alias(
                f.name
            )
            for f in df.schema.fields
        ]
    )


def redact_payloads(column: Column) -> Column:
    """Free JSON text with sensitive keys masked at any depth and sensitive strings replaced.

    Only texts with a sensitive word, the literal of a pattern, or an escape that
    could hide one are parsed; others are left as they are. Such a text that isn't
    JSON is masked as a whole.
    """
    import re

    whole = [re.compile(p) for p in fixed.WHOLE_VALUE_PATTERNS]

    def mask(value):
        if isinstance(value, str):
            return fixed.REDACTED if any(p.search(value) for p in whole) else value
        if isinstance(value, list):
            return [mask(v) for v in value]
        if isinstance(value, dict):
            return {k: fixed.REDACTED if is_sensitive_key(k) else mask(v) for k, v in value.items()}
        return value

    def redacted(text: str) -> str:
        try:
            return json.dumps(mask(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return fixed.REDACTED

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    needles = [NEEDLES[p] for p in fixed.WHOLE_VALUE_PATTERNS] + ["\\u"]
    suspect = _any_word(F.lower(column), F.lit(False))
    for needle in needles:
        suspect = suspect | F.contains(F.lower(column), F.lit(needle))
    return F.coalesce(masked(F.when(suspect, column)), column)
