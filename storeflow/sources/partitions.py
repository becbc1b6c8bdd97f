"""Parquet tables partitioned by date: pruned reads, replaced dates, merged states, packed files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.operators.cleaning import col
from storeflow.session import path_exists, remove_path

MAX_RANGES = 200
TARGET_BYTES = 128 << 20
DAY = dt.timedelta(days=1)


def distinct_dates(rows: DataFrame, column: str = "date") -> list[dt.date]:
    """The dates of some rows: as many as days that they span, whatever their number."""
    return sorted(r[0] for r in rows.select(column).distinct().collect() if r[0] is not None)


def date_ranges(dates: Sequence[dt.date], most: int = MAX_RANGES) -> list[tuple[dt.date, dt.date]]:
    """Dates as runs of days, first and last; above ``most`` runs those with the smallest gaps are joined."""
    runs: list[list[dt.date]] = []
    for day in sorted(dates):
        if runs and day - runs[-1][1] <= DAY:
            runs[-1][1] = day
        else:
            runs.append([day, day])
    if len(runs) > most:
        gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
        joined = set(gaps[: len(runs) - most])
        kept: list[list[dt.date]] = []
        for i, run in enumerate(runs):
            if i in joined:
                kept[-1][1] = run[1]
            else:
                kept.append(run)
        runs = kept
    return [(a, b) for a, b in runs]


def on_dates(dates: Sequence[dt.date], column: str = "date", most: int = MAX_RANGES) -> Column:
    """A filter of literals on a date column, which prunes partitions when a query is planned.

    Up to ``most`` runs of days are exact; beyond that the filter may let
    through dates between them.
    """
    found = F.lit(False)
    for first, last in date_ranges(dates, most):
        found = found | (F.col(column) == F.lit(first) if first == last else F.col(column).between(F.lit(first), F.lit(last)))
    return found


def read_dates(spark: SparkSession, path: str, schema, dates: Sequence[dt.date], column: str = "date") -> DataFrame:
    """The rows of these dates in a partitioned table; none where there is no table yet."""
    if not dates or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path).where(on_dates(dates, column))
    if len(date_ranges(dates)) == len(date_ranges(dates, len(dates))):
        return rows
    # The literals let dates in between through: leave those out by a join with the few wanted ones.
    wanted = spark.createDataFrame([(d,) for d in dates], f"`{column}` date")
    return rows.join(F.broadcast(wanted), column, "left_semi").select(rows.columns)


def write_dates(rows: DataFrame, path: str, partition_by: Sequence[str] = ("date",)) -> None:
    """Replace the partitions that ``rows`` has, and no others.

    Rows of a partition are gathered in few tasks; the hint lets adaptive
    execution split a hot date and merge small ones. ``rows`` must not read from
    ``path``: stage them first, as :func:`merge_dates` does.
    """
    gathered = rows.hint("rebalance", *[col(n) for n in partition_by])
    writer = gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def merge_dates(
    new: DataFrame, path: str, staged: str, combine: Callable[[DataFrame], DataFrame], column: str = "date",
    dates: Sequence[dt.date] | None = None,
) -> list[dt.date]:
    """Stage, for every date of ``new``, what ``combine`` makes of its old and new rows; return these dates.

    ``combine`` gets rows of the columns of ``new`` and returns the same
    columns. Only the touched dates of the table are read, by literals.
    :func:`publish` then moves the staged dates into the table.
    """
    spark = new.sparkSession
    touched = distinct_dates(new, column) if dates is None else list(dates)
    old = read_dates(spark, path, new.schema, touched, column)
    both = combine(old.select(new.columns).unionAll(new))
    typed = both.select([F.col(f"`{f.name}`").cast(f.dataType) for f in new.schema.fields])
    typed.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(staged)
    return touched


def publish(spark: SparkSession, staged: str, path: str, schema, partition_by: Sequence[str] = ("date",)) -> None:
    """Move staged partitions into the table; doing it again changes nothing."""
    if path_exists(spark, staged):
        write_dates(spark.read.schema(schema).parquet(staged), path, partition_by)


# --- many small files -------------------------------------------------------------------------

def partition_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for every data file: its path, its length and its partition values. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.drop("content", "modificationTime")


def small_partitions(
    spark: SparkSession, path: str, column: str = "date", target_bytes: int = TARGET_BYTES, least_files: int = 8
) -> DataFrame:
    """(column, files, bytes) of partitions with ``least_files`` or more files that are below half the target."""
    sizes = partition_files(spark, path).groupBy(column).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.count_if(F.col("length") < target_bytes // 2).alias("small"),
    )
    return sizes.where(F.col("small") >= least_files).drop("small")


def compact(
    spark: SparkSession, path: str, column: str = "date", target_bytes: int = TARGET_BYTES, least_files: int = 8,
    parallel: int = 4,
) -> DataFrame:
    """Pack the small files of each partition of a table, and report (column, files, bytes, files_after).

    Only partitions with many small files are touched, each by a job of its own,
    ``parallel`` of them at a time. A job reads its partition with files packed
    to scans of ``target_bytes``, so a scan task writes one file and nothing is
    shuffled. A partition is staged beside the table and then replaced, so it is
    either as before or packed; nobody else may write to it meanwhile.
    """
    base = path.rstrip("/")
    found = small_partitions(spark, base, column, target_bytes, least_files)
    work = [(r[column], r["files"], r["bytes"]) for r in found.orderBy(column).collect()]
    packing = spark.newSession()
    for key, value in {
        "spark.sql.files.maxPartitionBytes": target_bytes, "spark.sql.files.openCostInBytes": 0,
        "spark.sql.files.minPartitionNum": 1, "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }.items():
        packing.conf.set(key, str(value))
    schema = packing.read.parquet(base).schema

    def pack(value) -> int:
        staged = f"{base}-packed-{value}"
        mine = packing.read.schema(schema).parquet(base).where(F.col(column).eqNullSafe(F.lit(value)))
        mine.write.mode("overwrite").partitionBy(column).parquet(staged)
        packed = packing.read.schema(schema).parquet(staged)
        packed.write.mode("overwrite").partitionBy(column).parquet(base)
        files = partition_files(packing, staged).count()
        remove_path(spark, staged)
        return files

    with ThreadPoolExecutor(parallel) as pool:
        after = list(pool.map(inheritable_thread_target(spark)(pack), [value for value, _, _ in work]))
    report = [(value, files, size, n) for (value, files, size), n in zip(work, after)]
    kind = partition_files(spark, base).schema[column].dataType.simpleString()
    return spark.createDataFrame(report, f"`{column}` {kind}, files bigint, bytes bigint, files_after bigint")
