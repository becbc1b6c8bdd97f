"""Quantities and prices of point-of-sale rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SALES_PRICE_FACTOR = "0.92"
# --- end of fixed values ----------------------------------------------------


def valid_quantity(column: Column) -> Column:
    """Whole positive quantity from typed text; null where there is none.

    Everything that is not a digit is removed first, so ``-5`` reads as 5 and
    ``2.5`` as 25. Empty text and zero are not quantities.
    """
    digits = F.regexp_replace(column.cast("string"), r"\D", "").try_cast("int")
    return F.when(digits > 0, digits)


def sales_price(list_price: Column) -> Column:
    """Discounted unit price in cents precision."""
    exact = list_price.cast("decimal(12,2)") * F.lit(SALES_PRICE_FACTOR).cast("decimal(3,2)")
    return F.round(exact, 2).cast("decimal(12,2)")


def ext_sales_price(recorded: Column, quantity: Column, unit_price: Column) -> Column:
    """The recorded line total, or quantity times unit price where it is null or 0."""
    computed = quantity * unit_price
    return F.coalesce(F.nullif(recorded, F.lit(0)), computed).cast("decimal(14,2)")
