"""Data-quality rules: violations by name, and the split into clean and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = "^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"


def required(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) == "", F.lit(True))


def length_outside(column: str, low: int, high: int) -> Column:
    n = F.length(F.coalesce(F.col(column), F.lit("")))
    return (n < low) | (n > high)


def not_in(column: str, values: list) -> Column:
    return ~F.coalesce(F.col(column).isin(values), F.lit(False))


def outside(column: str, low: float, high: float) -> Column:
    return F.coalesce((F.col(column) < low) | (F.col(column) > high), F.lit(False))


def not_like(column: str, pattern: str) -> Column:
    return ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def with_violations(rows: DataFrame, rules: dict[str, Column], name: str = "violations") -> DataFrame:
    """``rows`` with the names of the broken rules, joined by commas; empty if there is none."""
    return rows.withColumn(name, F.concat_ws(",", *[F.when(test, rule) for rule, test in rules.items()]))


def split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with ``violations``)."""
    marked = with_violations(rows, rules)
    return marked.where("violations = ''").drop("violations"), marked.where("violations <> ''")
