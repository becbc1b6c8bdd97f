"""Raw sales rows to the clean hourly table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from storeflow.operators.cleaning import fill_configured, fill_unknown, gate_not_negative, typed_rows
from storeflow.operators.hourly import hourly_sales
from storeflow.spec import SalesSpec


def gate_hourly(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Business rules on the totals: they run before any null is filled."""
    gated = gate_not_negative(df, spec.target)
    gated = gate_not_negative(gated, spec.gross)
    return gate_not_negative(gated, spec.price, keep_null=True)


def fill_hourly(df: DataFrame, spec: SalesSpec) -> DataFrame:
    filled = fill_configured(df, spec.fills)
    return fill_unknown(filled, spec.categorical_columns, own_rule=spec.fills)


def promotion_names(promotions: Sequence[str | None] | None, spec: SalesSpec) -> list[str | None] | None:
    """Given promotions written as the cleaned rows have them."""
    if promotions is None or spec.promotion not in spec.categorical_columns:
        return None if promotions is None else list(promotions)
    return [None if p is None else str(p).strip().upper() for p in promotions]


def clean_hourly_sales(
    raw: DataFrame, spec: SalesSpec | None = None, promotions: Sequence[str | None] | None = None,
    form: str = "wide", unlisted: str = "error",
) -> DataFrame:
    """Type, roll up, gate and fill: one scan and one shuffle when promotions are given.

    ``form`` and ``unlisted`` say how promotions are shown, see ``hourly_sales``.
    """
    spec = spec or SalesSpec()
    kept = set(raw.columns) - set(spec.drop_columns)
    missing = [n for n in (*spec.group_keys, spec.time_column) if n not in kept]
    if missing:
        raise ValueError(f"cannot roll up to hours without {missing}")
    hourly = hourly_sales(typed_rows(raw, spec), spec, promotion_names(promotions, spec), form, unlisted)
    return fill_hourly(gate_hourly(hourly, spec), spec)
