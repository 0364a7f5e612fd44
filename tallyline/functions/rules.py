"""Rule sweeps: one pass over a table, one row per broken rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import fixed
from tallyline.functions.columns import SCOPE


@dataclass
class Rule:
    """`broken` is true where the row breaks the rule `path: code`."""

    path: str
    code: str
    broken: Column

    @property
    def message(self) -> str:
        return f"{self.path}: {self.code}"


def broken_rules(rules: list[Rule]) -> Column:
    """Messages of the rules a row breaks, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.message)) for r in rules]))


def violations(df: DataFrame, table: str, row_key: Column, rules: list[Rule], scope: list[str] = SCOPE) -> DataFrame:
    return df.select(
        *scope,
        F.lit(table).alias("table_name"),
        row_key.cast("string").alias("row_key"),
        F.explode(broken_rules(rules)).alias("violation"),
    )


def not_null(name: str) -> Rule:
    return Rule(name, "required", F.col(name).isNull())


def at_least(name: str, low: float) -> Rule:
    return Rule(name, f"below {low}", F.col(name) < low)


def between(name: str, low: float, high: float) -> Rule:
    return Rule(name, f"outside {low}..{high}", ~F.col(name).between(low, high))


def one_of(name: str, values: list[str]) -> Rule:
    return Rule(name, "not in enumeration", ~F.col(name).isin(values))


def matches(name: str, pattern: str) -> Rule:
    return Rule(name, "invalid format", ~F.col(name).rlike(pattern))


def scope_rules() -> list[Rule]:
    """Tenant and project ids: present and of the contract's form."""
    return [
        not_null("tenant_id"),
        matches("tenant_id", fixed.TENANT_PATTERN),
        not_null("project_id"),
        matches("project_id", fixed.PROJECT_PATTERN),
    ]
