"""Time steps, model roles and training windows of hourly series.

The input has one row per series and hour, so a series is bounded by the hours
of its history, not by its sales: a best-seller is no longer than any other. Very
long series are cut into overlapping pieces, so that one series is many tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storeflow.operators.cleaning import col
from storeflow.spec import SalesSpec

SECONDS_PER_HOUR = 3600


def time_index(hourly: DataFrame, keys: Sequence[str], time_column: str) -> DataFrame:
    """Add ``time_idx``: hours since the first hour of the row's series."""
    series = Window.partitionBy(*[col(k) for k in keys])
    second = F.unix_timestamp(col(time_column).cast("timestamp"))
    hours = (second - F.min(second).over(series)) / SECONDS_PER_HOUR
    return hourly.withColumn("time_idx", hours.cast("int"))


def role_columns(
    df: DataFrame, roles: Mapping[str, Sequence[str]]
) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Columns per role: those that exist and those that do not."""
    have = set(df.columns)
    found = {role: [n for n in names if n in have] for role, names in roles.items()}
    absent = {role: [n for n in names if n not in have] for role, names in roles.items()}
    return found, absent


def role_projection(df: DataFrame, roles: Mapping[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """The keys and one struct per role with its existing columns.

    Roles without any existing column are left out; see :func:`role_columns`.
    """
    found, _ = role_columns(df, roles)
    structs = [
        F.struct(*[col(n).alias(n) for n in names]).alias(role) for role, names in found.items() if names
    ]
    return df.select(*[col(k) for k in keys], *structs)


def _names(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def densify(
    hourly: DataFrame, keys: Sequence[str], time_column: str, measure: str | Sequence[str],
    static: Sequence[str] = (), start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """Add the hours without sales, with measures of 0 (numbers) or null, between first and last hour.

    ``static`` columns have one value per series, the smallest, in every hour.
    ``start`` and ``end`` bound the hours, so that one wrong year does not add
    a million of them. Rows outside, and rows without a time, are left out.
    """
    key_columns = [col(k) for k in keys]
    measures = _names(measure)
    moment = col(time_column).cast("timestamp")
    rows = hourly.filter(moment.isNotNull())
    if start is not None:
        rows = rows.filter(moment >= F.lit(start))
    if end is not None:
        rows = rows.filter(moment <= F.lit(end))
    fixed = [F.min(col(n)).alias(n) for n in static]
    spans = rows.groupBy(*key_columns).agg(F.min(moment).alias("lo"), F.max(moment).alias("hi"), *fixed)
    steps = F.sequence("lo", "hi", F.expr("interval 1 hour"))
    grid = spans.select(*key_columns, *[col(n) for n in static], F.explode(steps).alias(time_column))
    known = rows.select(*key_columns, moment.alias(time_column), *[col(n) for n in measures])
    return grid.join(known, [*keys, time_column], "left").na.fill(0, measures)


def numbered_steps(
    rows: DataFrame, keys: Sequence[str], time_column: str, order: Sequence[str], hours: int, name: str
) -> DataFrame:
    """Add ``name``: the place of a row in its series, from 0, without a series in one task.

    Rows are numbered within stretches of ``hours`` hours; the stretches of a
    series, which are few, are counted and added up. Null times come first, ties
    follow the columns of ``order``.
    """
    second = F.unix_timestamp(col(time_column).cast("timestamp"))
    stretch = F.coalesce(F.floor(second / (hours * SECONDS_PER_HOUR)), F.lit(-(1 << 62)))
    series = F.struct(*[col(k) for k in keys])  # a null key is a key like any other
    cut = rows.select("*", series.alias("__series"), stretch.alias("__stretch"))
    within = Window.partitionBy("__series", "__stretch").orderBy(col(time_column), *[col(n) for n in order])
    numbered = cut.withColumn("__place", F.row_number().over(within) - 1)
    sizes = cut.groupBy("__series", "__stretch").agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy("__series").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__series", "__stretch", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    joined = numbered.join(starts, ["__series", "__stretch"])
    return joined.select(*[col(n) for n in rows.columns], (F.col("__start") + F.col("__place")).alias(name))


def training_sequences(
    hourly: DataFrame,
    keys: Sequence[str],
    time_column: str,
    measure: str | Sequence[str],
    history: int = 30,
    horizon: int = 7,
    dense: bool = False,
    static: Sequence[str] = (),
    piece: int | None = None,
) -> DataFrame:
    """Per series and time: the last ``history`` and the next ``horizon`` values.

    One measure gives arrays of its values, several give arrays of structs; a
    null is a value like any other. Rows without a full horizon are left out; the
    history may be shorter at the start of a series. Steps are rows, in order of
    time and then of their values, or hours with ``dense``. ``static`` columns
    stay beside the arrays.

    A series is one window and so one task. ``piece`` cuts it into pieces of that
    many steps, each with the ``history`` and ``horizon`` steps around it, which
    are windows of their own; the result is the same. It costs a shuffle to number
    the steps: for series of far more than ``piece`` rows, or a few long ones.
    """
    rows = densify(hourly, keys, time_column, measure, static) if dense else hourly
    measures = _names(measure)
    key_columns, steps = [col(k) for k in keys], F.struct(*[col(n).alias(n) for n in measures])
    narrow = list(dict.fromkeys([*keys, *static, time_column, *measures]))
    rows = rows.select(*[col(n) for n in narrow])
    if piece is None:
        series = Window.partitionBy(*key_columns).orderBy(col(time_column), *[col(n) for n in measures])
        mine = F.lit(True)
    else:
        if piece < 1:
            raise ValueError("a piece has at least one step")
        rows = numbered_steps(rows, keys, time_column, measures, max(piece, history + horizon), "__at")
        # The pieces that need a step: those of the rows whose history or horizon it is in.
        first = F.floor(F.greatest(F.col("__at") - horizon, F.lit(0)) / piece)
        last = F.floor((F.col("__at") + history - 1) / piece)
        rows = rows.withColumn("__piece", F.explode(F.sequence(first, last)))
        series = Window.partitionBy(*key_columns, "__piece").orderBy("__at")
        mine = F.floor(F.col("__at") / piece) == F.col("__piece")
    # Structs: a list of plain values would leave nulls out.
    past = F.collect_list(steps).over(series.rowsBetween(1 - history, 0))
    future = F.collect_list(steps).over(series.rowsBetween(1, horizon))
    windows = rows.select("*", past.alias("history"), future.alias("horizon")).where(mine & (F.size("horizon") == horizon))
    plain = isinstance(measure, str)
    arrays = [
        (F.transform(n, lambda x: x[measure]) if plain else F.col(n)).alias(n) for n in ("history", "horizon")
    ]
    return windows.select(*key_columns, *[col(n) for n in static], col(time_column), *arrays)


def model_sequences(hourly: DataFrame, spec: SalesSpec, dense: bool = False, piece: int | None = None) -> DataFrame:
    """Training windows over all time-varying covariates of the spec, with its static ones and its lengths."""
    found, _ = role_columns(hourly, spec.roles)
    plain = {*spec.group_keys, spec.time_column}
    pick = lambda start: [
        n for n in dict.fromkeys(n for role, names in found.items() if role.startswith(start) for n in names) if n not in plain
    ]
    varying, static = pick("time_varying"), pick("static")
    return training_sequences(
        hourly, spec.group_keys, spec.time_column, varying, spec.history, spec.horizon, dense,
        [n for n in static if n not in varying], piece,
    )
