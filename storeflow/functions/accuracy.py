"""Forecast against actual quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: lower limits of the accuracy bands -----------------------
HIGH_FROM = 85
MEDIUM_FROM = 60
# --- end of fixed values ----------------------------------------------------


def difference(predicted: Column, actual: Column) -> Column:
    """Positive when too much was predicted."""
    return predicted - actual


def accuracy_pct(predicted: Column, actual: Column) -> Column:
    """Percent of the actual quantity that was hit, one decimal, never below 0.

    Nothing predicted and nothing sold counts as 100; sales of 0 against a
    forecast count as 0.
    """
    missed = F.abs(predicted - actual)
    share = F.round(F.lit(100.0) * (actual - missed) / actual, 1)
    return (
        F.when((predicted == 0) & (actual == 0), 100.0)
        .when(actual == 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), share))
    )


def accuracy_band(accuracy: Column) -> Column:
    """``high``, ``medium`` or ``low``; a missing accuracy is low."""
    return (
        F.when(accuracy >= HIGH_FROM, "high")
        .when(accuracy >= MEDIUM_FROM, "medium")
        .otherwise("low")
    )
