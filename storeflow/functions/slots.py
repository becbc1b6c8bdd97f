"""The twelve two-hour kitchen slots of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.functions.literals import literal_rows

HOURS_PER_SLOT = 2

# --- fixed values: labels shown for slots 1 to 12 ---------------------------
SLOT_LABELS = (
    "12–2 AM", "2–4 AM", "4–6 AM", "6–8 AM", "8–10 AM", "10–12 PM",
    "12–2 PM", "2–4 PM", "4–6 PM", "6–8 PM", "8–10 PM", "10–12 AM",
)
# --- end of fixed values ----------------------------------------------------


def slot_of(column: Column) -> Column:
    """Slot number 1 to 12 of a time."""
    return (F.floor(F.hour(column) / HOURS_PER_SLOT) + 1).cast("int")


def slots(spark: SparkSession) -> DataFrame:
    """The slot dimension: slot, start, end, label (always 12 rows)."""
    rows = [
        (n + 1, f"{n * HOURS_PER_SLOT:02d}:00", f"{(n + 1) * HOURS_PER_SLOT:02d}:00", label)
        for n, label in enumerate(SLOT_LABELS)
    ]
    return literal_rows(spark, ("slot", "start", "end", "label"), rows)
