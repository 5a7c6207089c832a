"""Ratios with an explicit rule for an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """numerator / denominator, or ``empty`` when the denominator is zero or null."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(empty).cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(F.lit(0.0))


def count_if(condition: Column) -> Column:
    """Rows where the condition is true; null counts as false."""
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")
