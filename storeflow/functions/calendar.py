"""Calendar parts and their cyclical encoding."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: parts with a cycle and the length of that cycle ----------
PERIODS = {"hour": 24, "dayofweek": 7, "month": 12, "weekofyear": 52, "dayofmonth": 31}
WEEKEND = (1, 7)
# --- end of fixed values ----------------------------------------------------


def is_weekend(column: Column) -> Column:
    """1 on Saturday and Sunday, else 0 (also for a null date)."""
    return F.when(F.dayofweek(column).isin(*WEEKEND), 1).otherwise(0)


PARTS = {
    "hour": F.hour,
    "dayofweek": F.dayofweek,
    "dayofmonth": F.dayofmonth,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
    "weekofyear": F.weekofyear,
    "isweekend": is_weekend,
    "is_weekend": is_weekend,
}


def hour_bucket(column: Column) -> Column:
    """Start of the hour."""
    return F.date_trunc("hour", column)


def cycle_pair(part: Column, period: int, name: str) -> list[Column]:
    """Sine and cosine of a part's position in its cycle."""
    angle = part * (2 * math.pi) / period
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def calendar_columns(source: str, parts: Iterable[str]) -> list[Column]:
    """Output columns for the parts of one date column.

    Parts with a cycle give a sine/cosine pair, the others their plain value.
    Unknown part names are left out.
    """
    made: list[Column] = []
    for part in parts:
        if part not in PARTS:
            continue
        value = PARTS[part](F.col(f"`{source}`"))
        name = f"{source}_{part}"
        made += cycle_pair(value, PERIODS[part], name) if part in PERIODS else [value.alias(name)]
    return made
