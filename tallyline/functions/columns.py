"""Column helpers: scope keys, event order, ISO time text, money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCOPE = ["tenant_id", "project_id"]
ORDER_FIELDS = ["timestamp", "event_id", "ingest_seq"]
DAY_MILLIS = 86_400_000.0


def event_order() -> Column:
    """The one total order of events: time, then id, then arrival."""
    return F.struct(*[F.col(c) for c in ORDER_FIELDS])


def present(name: str) -> Column:
    """True where an optional text field holds something: absent and '' are alike."""
    return F.col(name).isNotNull() & (F.col(name) != "")


def instant(text: str) -> Column:
    """A literal ISO-8601 text as TIMESTAMP."""
    return F.to_timestamp(F.lit(text))


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis_between(later: Column, earlier: Column) -> Column:
    """Difference in whole milliseconds, each side cut to milliseconds first."""
    return F.unix_millis(later) - F.unix_millis(earlier)


def days_between(later: Column, earlier: Column) -> Column:
    return millis_between(later, earlier).cast("double") / F.lit(DAY_MILLIS)


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def dollars(cents: Column) -> Column:
    """Cents as a text with two decimals, exact."""
    return (cents.cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,2)").cast("string")


def percent_text(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, rounded half up on the exact ratio."""
    ratio = F.try_divide(
        part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)"), whole.cast("decimal(20,0)")
    )
    return F.when(whole > 0, F.round(ratio, 1).cast("decimal(38,1)").cast("string")).otherwise("0.0")
