"""Log and standard scaling with statistics kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.operators.cleaning import col, present, replace_columns
from storeflow.session import fresh_path, remove_path
from storeflow.sources.partitions import merge_dates, publish


def log1p_target(df: DataFrame, target: str) -> DataFrame:
    if target not in df.columns:
        return df
    return replace_columns(df, {target: F.log1p(col(target).cast("double"))})


def _measure(df: DataFrame, wanted: Sequence[str], skip_nan: bool = False) -> DataFrame:
    """One row with mean ``m<i>`` and deviation ``s<i>`` of every column."""
    if not wanted:
        raise ValueError("none of the columns to scale exists")

    def value(name: str) -> Column:
        number = col(name).cast("double")
        return F.when(~F.isnan(number), number) if skip_nan else number

    return df.agg(
        *[F.mean(value(n)).alias(f"m{i}") for i, n in enumerate(wanted)],
        *[F.stddev_samp(value(n)).alias(f"s{i}") for i, n in enumerate(wanted)],
    )


def _stored(scaler: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The same row from a stored scaler, which must have an entry for every column."""

    def pick(name: str, measure: str) -> Column:
        missing = F.raise_error(F.lit(f"the stored scaler has no column {name}")).cast("double")
        hit = F.col("feature") == name
        return F.when(F.count_if(hit) > 0, F.max(F.when(hit, F.col(measure)))).otherwise(missing)

    return scaler.agg(
        *[pick(n, "mean").alias(f"m{i}") for i, n in enumerate(wanted)],
        *[pick(n, "std").alias(f"s{i}") for i, n in enumerate(wanted)],
    )


def _bind(row: DataFrame, wanted: Sequence[str]) -> Column:
    """The row as a scalar subquery: rows are neither joined nor collected.

    The divisor of a column without spread becomes 1, here once and not for
    every row that is scaled.
    """
    fields = []
    for i in range(len(wanted)):
        spread = F.col(f"s{i}")
        fields += [F.col(f"m{i}"), F.when(spread != 0, spread).otherwise(1.0).alias(f"s{i}")]
    return row.select(F.struct(*fields).alias("stats")).scalar()


def _scaled(df: DataFrame, stats: Column, wanted: Sequence[str]) -> DataFrame:
    return replace_columns(df, {
        name: (col(name).cast("double") - stats[f"m{i}"]) / stats[f"s{i}"] for i, name in enumerate(wanted)
    })


def fit_scaler(df: DataFrame, names: Sequence[str], skip_nan: bool = False) -> DataFrame:
    """``scaler(feature, mean, std)`` from one global aggregate.

    A NaN makes mean and deviation of its column NaN; ``skip_nan`` leaves such
    values out of the statistics instead.
    """
    wanted = present(df, names)
    entries = [
        F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, n in enumerate(wanted)
    ]
    return _measure(df, wanted, skip_nan).select(F.inline(F.array(*entries)))


MOMENTS = "feature string, n bigint, mean double, m2 double"


def moments(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), skip_nan: bool = False) -> DataFrame:
    """``(by, feature, n, mean, m2)``: count, mean and squared deviations, which later rows can be added to."""
    wanted = present(df, names)
    if not wanted:
        raise ValueError("none of the columns to measure exists")
    cells = []
    for name in wanted:
        number = col(name).cast("double")
        value = F.when(~F.isnan(number), number) if skip_nan else number
        cells.append(F.struct(
            F.lit(name).alias("feature"), F.count(value).alias("n"), F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("m2"),
        ))
    grouped = df.groupBy(*[col(b) for b in by]).agg(F.array(*cells).alias("cells"))
    return grouped.select(*[col(b) for b in by], F.inline("cells"))


def merge_moments(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the union of all parts with the same ``by`` and feature.

    A part's deviations count around its own mean; what its mean is off the
    common one is added for each of its rows, so nothing large cancels out. A
    part without values changes nothing.
    """
    keys = [*by, "feature"]
    key = F.struct(*[col(k) for k in keys])
    totals = parts.groupBy(key.alias("__key")).agg(
        F.sum("n").alias("__n"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("__mean")
    )
    off = F.col("mean") - F.col("__mean")
    joined = parts.join(totals, key.eqNullSafe(F.col("__key"))).select(
        *[col(k) for k in keys], "__n", "__mean", F.coalesce(F.col("m2") + F.col("n") * off * off, F.lit(0.0)).alias("m2")
    )
    merged = joined.groupBy(*[col(k) for k in keys], "__n", "__mean").agg(F.sum("m2").alias("m2"))
    return merged.select(*[col(k) for k in keys], F.col("__n").alias("n"), F.col("__mean").alias("mean"), "m2")


def moments_scaler(parts: DataFrame) -> DataFrame:
    """``scaler(feature, mean, std)`` as :func:`fit_scaler` gives it, from moments of any number of parts."""
    merged = merge_moments(parts)
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged.select("feature", "mean", spread.alias("std"))


def add_moments(
    new: DataFrame, names: Sequence[str], path: str, date: str = "date", replace: bool = False, skip_nan: bool = False
) -> None:
    """Bring a table of moments per date up to date with new rows, without the rows before them.

    The moments of the new rows' dates are merged with those stored for the same
    dates, or take their place with ``replace``, which can be repeated; no other
    date is read or written. The table has a row per date and feature.
    """
    spark, staged = new.sparkSession, f"{path.rstrip('/')}-staged"
    measured = moments(new.where(col(date).isNotNull()), names, [date], skip_nan).select(*MOMENT_COLUMNS, col(date))
    if replace:
        measured.write.mode("overwrite").partitionBy(date).parquet(staged)
    else:
        measured = materialised(measured, fresh_path(spark, "moments"))
        merge_dates(measured, path, staged, lambda rows: merge_moments(rows, [date]).select(measured.columns), date)
    publish(spark, staged, path, measured.schema, [date])
    remove_path(spark, staged)


MOMENT_COLUMNS = ("feature", "n", "mean", "m2")


def materialised(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_moments(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    return spark.read.schema(f"{MOMENTS}, `{date}` date").parquet(path)


def apply_scaler(df: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(x - mean) / std``; columns without spread are only centred."""
    wanted = present(df, names)
    return _scaled(df, _bind(_stored(scaler, wanted), wanted), wanted)


def undo_scaler(df: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    """The inverse of :func:`apply_scaler`."""
    wanted = present(df, names)
    stats = _bind(_stored(scaler, wanted), wanted)
    return replace_columns(df, {
        name: col(name) * stats[f"s{i}"] + stats[f"m{i}"] for i, name in enumerate(wanted)
    })


def standard_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fit on the rows and apply to the same rows, without a table in between."""
    wanted = present(df, names)
    return _scaled(df, _bind(_measure(df, wanted), wanted), wanted)
