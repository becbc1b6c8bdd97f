"""Text rules for categoricals and flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_trim(column: Column) -> Column:
    """Upper-cased text without surrounding blanks; other types become text first."""
    return F.upper(F.trim(column.cast("string")))


def binary_flag(column: Column, truthy: Iterable[str] = ("Y",), hit: int = 1, miss: int = 0) -> Column:
    """``hit`` for a truthy text, ``miss`` for anything else and for null."""
    accepted = [str(v).strip().upper() for v in truthy]
    return F.when(upper_trim(column).isin(accepted), hit).otherwise(miss)
