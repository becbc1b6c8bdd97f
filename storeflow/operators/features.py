"""Calendar columns and flags of the feature table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from storeflow.functions.calendar import calendar_columns
from storeflow.functions.text import binary_flag
from storeflow.operators.cleaning import col, present, replace_columns


def add_calendar(df: DataFrame, calendar: Mapping[str, Iterable[str]]) -> DataFrame:
    """All calendar parts of all date columns in one projection."""
    made = [c for name in present(df, calendar) for c in calendar_columns(name, calendar[name])]
    return df.select("*", *made)


def binary_flags(
    df: DataFrame, names: Iterable[str], truthy: Iterable[str] = ("Y",), values: tuple[int, int] = (1, 0)
) -> DataFrame:
    """The first of ``values`` for a truthy text, the second for anything else."""
    accepted = tuple(truthy)
    return replace_columns(df, {n: binary_flag(col(n), accepted, *values) for n in present(df, names)})
