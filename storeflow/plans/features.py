"""The clean hourly table to the numeric feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from storeflow.operators.features import add_calendar, binary_flags
from storeflow.operators.labels import apply_labels, fit_labels
from storeflow.operators.scaling import apply_scaler, fit_scaler, log1p_target
from storeflow.spec import SalesSpec


def unscaled_features(hourly: DataFrame, spec: SalesSpec) -> DataFrame:
    """Calendar, flags and the log of the target: no statistics needed."""
    made = binary_flags(add_calendar(hourly, spec.calendar), spec.flag_columns, spec.truthy, spec.flag_values)
    return log1p_target(made, spec.log_column or spec.target) if spec.log_target else made


def fitted_steps(hourly: DataFrame, spec: SalesSpec) -> tuple[bool, bool]:
    """Whether there is anything to scale, and anything to label."""
    names = set(hourly.columns)
    scale = bool(spec.scaled_columns) and bool(names.intersection(spec.features_to_scale))
    return scale, spec.label_categoricals and bool(names.intersection(spec.categorical_columns))


def fit_features(
    hourly: DataFrame, spec: SalesSpec, labels_path: str | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """The fitted tables ``scaler`` and ``labels``; None for a step without columns."""
    needs_scaler, needs_labels = fitted_steps(hourly, spec)
    scaler = fit_scaler(unscaled_features(hourly, spec), spec.features_to_scale) if needs_scaler else None
    labels = fit_labels(hourly, spec.categorical_columns, labels_path) if needs_labels else None
    return scaler, labels


def model_features(
    hourly: DataFrame,
    spec: SalesSpec | None = None,
    scaler: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Calendar, flags, scaling and labels in that order.

    Without fitted tables they are fitted on the rows themselves; pass stored
    ones to treat new rows like old ones; a column that they do not cover fails
    the query. ``hourly`` is read once per fitted
    table and once more to apply them, so it should be a stored table.
    """
    spec = spec or SalesSpec()
    stored = scaler is not None or labels is not None
    if not stored:
        scaler, labels = fit_features(hourly, spec)
    made = unscaled_features(hourly, spec)
    if scaler is not None:
        made = apply_scaler(made, scaler, spec.features_to_scale)
    if labels is not None:
        made = apply_labels(made, labels, spec.categorical_columns, strict=stored)
    return made
