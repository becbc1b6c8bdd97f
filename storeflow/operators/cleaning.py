"""Typing, normalising, gating and filling of sales rows.

Each step touches only the columns that exist and builds one projection, so a
chain of steps collapses into a single scan. ``column_report`` tells which
columns were absent and how many values could not be converted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeflow.columns import UNKNOWN
from storeflow.functions.calendar import hour_bucket
from storeflow.functions.text import upper_trim
from storeflow.spec import SalesSpec


def col(name: str) -> Column:
    """A column by its exact name, also with blanks or dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def replace_columns(df: DataFrame, change: Mapping[str, Column]) -> DataFrame:
    """One projection with some columns replaced in place."""
    return df.select(*[change[n].alias(n) if n in change else col(n) for n in df.columns])


def drop_configured(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*present(df, names))


def normalise_categoricals(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return replace_columns(df, {n: upper_trim(col(n)) for n in present(df, names)})


def parse_timestamps(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text to timestamp; unreadable text becomes null."""
    return replace_columns(df, {n: col(n).try_cast("timestamp") for n in present(df, names)})


def parse_dates(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text to date; unreadable text becomes null."""
    return replace_columns(df, {n: col(n).try_cast("date") for n in present(df, names)})


def cast_numerics(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """To double; unreadable text becomes null."""
    return replace_columns(df, {n: col(n).try_cast("double") for n in present(df, names)})


def add_hour(df: DataFrame, time_column: str, name: str) -> DataFrame:
    return df.withColumn(name, hour_bucket(col(time_column)))


def restore_time_column(df: DataFrame, time_column: str, hour: str) -> DataFrame:
    """The hour takes the place of the raw time."""
    rest = [col(n) for n in df.columns if n not in (time_column, hour)]
    return df.select(*rest, col(hour).alias(time_column))


def gate_not_negative(df: DataFrame, name: str, keep_null: bool = False) -> DataFrame:
    """Rows with a value of at least 0; null rows only on request."""
    if name not in df.columns:
        return df
    passes = col(name) >= 0
    return df.filter(passes | col(name).isNull()) if keep_null else df.filter(passes)


def fill_configured(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Configured defaults, where the default suits the column's type."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def suits(name: str, value: object) -> bool:
        wanted = T.StringType if isinstance(value, str) else T.NumericType
        return isinstance(types.get(name), wanted)

    active = {n: v for n, v in fills.items() if suits(n, v)}
    # Backquotes are only needed, and only understood, for names with a dot.
    active = {f"`{n}`" if "." in n else n: v for n, v in active.items()}
    return df.na.fill(active) if active else df


def fill_unknown(df: DataFrame, names: Iterable[str], own_rule: Iterable[str] = ()) -> DataFrame:
    """``UNKNOWN`` in text categoricals that have no default of their own."""
    skip = set(own_rule)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return fill_configured(df, {n: UNKNOWN for n in names if n in text and n not in skip})


def typed_rows(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Drop, normalise and type in one projection."""
    kept = drop_configured(df, spec.drop_columns)
    change = {n: upper_trim(col(n)) for n in present(kept, spec.categorical_columns)}
    change |= {n: col(n).try_cast("timestamp") for n in present(kept, [spec.time_column])}
    change |= {n: col(n).try_cast("date") for n in present(kept, spec.date_columns)}
    change |= {n: col(n).try_cast("double") for n in present(kept, spec.numeric_columns)}
    if isinstance(dict((f.name, f.dataType) for f in kept.schema.fields).get(spec.target), T.StringType):
        change[spec.target] = col(spec.target).try_cast("double")
    return replace_columns(kept, change)


def report_parts(df: DataFrame, spec: SalesSpec) -> tuple[list[Column], list[tuple[str, str, bool, str | None]]]:
    """What a report counts, as aggregates ``r<n>``, and its rows: column, step, present, aggregate if any."""
    conversions = {
        "timestamp": ([spec.time_column], "timestamp"),
        "date": (spec.date_columns, "date"),
        "numeric": (spec.numeric_columns, "double"),
    }
    plain = {
        "drop": spec.drop_columns,
        "categorical": spec.categorical_columns,
        "group_key": spec.group_keys,
        "gate": (spec.target, spec.gross, spec.price),
        "fill": spec.fills,
        "calendar": spec.calendar,
        "flag": spec.flag_columns,
        "scale": spec.features_to_scale,
    }
    have = set(df.columns)
    counts, rows = [], []
    for step, (names, kind) in conversions.items():
        for name in names:
            key = None
            if name in have:
                key = f"r{len(counts)}"
                lost = col(name).isNotNull() & col(name).try_cast(kind).isNull()
                counts.append(F.count_if(lost).alias(key))
            rows.append((name, step, name in have, key))
    for step, names in plain.items():
        rows += [(name, step, name in have, None) for name in names]
    return counts, rows


def column_report(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Which step expects which column, is it there, how many values it rejects.

    One pass over the rows counts the values that turn into null when typed;
    the report has one row per (step, column).
    """
    counts, rows = report_parts(df, spec)
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(step).alias("expected_by"),
            F.lit(there).alias("present"),
            (F.col(key) if key else F.lit(0).cast("bigint")).alias("rejected"),
        )
        for name, step, there, key in rows
    ]
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    return totals.select(F.inline(F.array(*entries)))


def observed_report(df: DataFrame, spec: SalesSpec) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The rows, and a function for their report once these rows have been written.

    The counts are taken in passing, so the report costs no pass of its own.
    """
    counts, rows = report_parts(df, spec)
    seen = Observation("column report")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)

    def report() -> DataFrame:
        found = seen.get
        lines = [(name, step, there, int(found[key]) if key else 0) for name, step, there, key in rows]
        return df.sparkSession.createDataFrame(lines, "column string, expected_by string, present boolean, rejected long")

    return watched, report
