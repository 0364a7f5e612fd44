"""Analysis periods: the same for all tenants, or one for each.

Both kinds have the same methods, so operators don't tell them apart. A table of
periods is joined to the rows as bounds. The earliest start and the latest end are
looked up once and filter the rows before that join, as literals that reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import SCOPE, instant
from tallyline.functions.materialise import store
from tallyline.functions.skew import salted_join

# A table of periods is broadcast up to so many tenants (some 200 bytes each), else copied under salts.
MOST_TENANTS = 100_000
FIELDS = ["period_start", "period_end", "reference_date"]


@dataclass(frozen=True)
class Period:
    """One period and detector reference date for everybody, as ISO texts."""

    period_start: str
    period_end: str
    reference_date: str | None = None

    def within(self, events: DataFrame) -> DataFrame:
        """Events of the period, both ends included."""
        return events.where(F.col("timestamp").between(instant(self.period_start), instant(self.period_end)))

    def known(self, rows: DataFrame, spread_by: str) -> DataFrame:
        """Rows of tenants that have a period: all."""
        return rows

    def attach(self, rows: DataFrame, *names: str, spread_by: Column | None = None) -> DataFrame:
        """Rows with the period's texts as columns."""
        return rows.withColumns({n: F.lit(getattr(self, n)) for n in names})


class Periods:
    """A period per tenant and project, from (scope, period_start, period_end, reference_date), ISO texts.

    Without a reference date the end of the period is taken. Tenants without a row, or
    with one that lacks an end or a start, have no period and no results; of a tenant's
    repeated rows the least counts. The table is written once.
    """

    def __init__(self, table: DataFrame):
        reference = F.col("reference_date") if "reference_date" in table.columns else F.lit(None).cast("string")
        row = F.struct("period_start", "period_end", F.coalesce(reference, "period_end").alias("reference_date"))
        whole = table.where(F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
        self.table = store(whole.groupBy(*SCOPE).agg(F.min(row).alias("row")).select(*SCOPE, "row.*"))
        start, end = (F.to_timestamp(c) for c in FIELDS[:2])
        found = self.table.agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("n")).first()
        self.first, self.last, self.n = found

    def _joined(self, rows: DataFrame, own: DataFrame, spread_by: Column) -> DataFrame:
        if self.n <= MOST_TENANTS:
            return rows.join(F.broadcast(own), SCOPE)
        return salted_join(rows, own, SCOPE, spread_by)

    def within(self, events: DataFrame) -> DataFrame:
        """Events of their tenants' periods, both ends included."""
        at = F.col("timestamp")
        start, end = (F.to_timestamp(c).alias(f"own_{c}") for c in FIELDS[:2])
        rows = events.where(at.between(F.lit(self.first), F.lit(self.last)))
        joined = self._joined(rows, self.table.select(*SCOPE, start, end), F.col("event_id"))
        return joined.where(at.between(F.col("own_period_start"), F.col("own_period_end"))).select(*events.columns)

    def known(self, rows: DataFrame, spread_by: str) -> DataFrame:
        """Rows of tenants that have a period."""
        return self._joined(rows, self.table.select(*SCOPE), F.col(spread_by)).select(*rows.columns)

    def attach(self, rows: DataFrame, *names: str, spread_by: Column | None = None) -> DataFrame:
        """Rows with their tenants' texts as columns; those of tenants without a period go.

        `spread_by` varies within a tenant, where a tenant has many rows.
        """
        own = self.table.select(*SCOPE, *names)
        if spread_by is None:
            return rows.join(own, SCOPE)
        return self._joined(rows, own, spread_by)


def period_of(start: str | Period | Periods, end: str | None = None) -> Period | Periods:
    """What two texts, a period, or a table of periods mean."""
    return Period(start, end, end) if isinstance(start, str) else start


def detected(rows: DataFrame, reference_date: str | Period | Periods, spread_by: Column | None = None) -> DataFrame:
    """Rows with the time `detected_at` of their tenants' reference dates."""
    if isinstance(reference_date, str):
        return rows.withColumn("detected_at", instant(reference_date))
    dated = reference_date.attach(rows, "reference_date", spread_by=spread_by)
    return dated.withColumn("detected_at", F.to_timestamp("reference_date")).drop("reference_date")
