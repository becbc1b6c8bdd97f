"""Uploaded predictions: every upload kept, and the newest of every key at hand.

A folder has two tables, both partitioned by date: ``uploads`` with all rows as
they came, and ``latest`` with one row per key, which each upload brings up to
date on its own dates. Reading ``latest`` is a scan, however many uploads there were.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeflow.operators.forecast import KEYS, latest_predictions
from storeflow.session import remove_path
from storeflow.sources.partitions import distinct_dates, merge_dates, on_dates, publish

PREDICTIONS = T.StructType([
    T.StructField("prediction_slot", T.IntegerType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("item_subtype", T.StringType()),
    T.StructField("predicted_quantity", T.IntegerType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("date", T.DateType()),
])


def upload(predictions: DataFrame, path: str, name: str) -> list[dt.date]:
    """Store an upload under its name and bring ``latest`` up to date; return its dates.

    The same name again replaces that upload's rows and merges them again: with
    equal rows nothing changes, so an upload that was cut off is simply repeated.
    Rows without a date have no place to go to and are refused.
    """
    spark, base = predictions.sparkSession, path.rstrip("/")
    checked = F.coalesce("date", F.raise_error(F.lit("a prediction has no date")).cast("date")).alias("date")
    typed = [F.col(f.name).cast(f.dataType) for f in PREDICTIONS.fields if f.name != "date"]
    kept = f"{base}/uploads/upload={name}"
    rows = predictions.select(*typed, checked)
    rows.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(kept)
    stored = spark.read.schema(PREDICTIONS).parquet(kept)
    staged = f"{base}/staged"
    dates = merge_dates(stored, f"{base}/latest", staged, lambda both: latest_predictions(both).select(PREDICTIONS.names))
    publish(spark, staged, f"{base}/latest", PREDICTIONS)
    remove_path(spark, staged)
    return dates


def read_latest(spark: SparkSession, path: str, dates: Sequence[dt.date] | None = None) -> DataFrame:
    """The newest prediction of every key; with ``dates`` only their partitions are read."""
    rows = spark.read.schema(PREDICTIONS).parquet(f"{path.rstrip('/')}/latest")
    rows = rows if dates is None else rows.where(on_dates(dates))
    return rows.select(*KEYS, "predicted_quantity", "model_version", "uploaded_at")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all uploads, with the upload's name."""
    schema = T.StructType([*PREDICTIONS.fields[:-1], T.StructField("upload", T.StringType()), PREDICTIONS.fields[-1]])
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/uploads")


def rebuild_latest(spark: SparkSession, path: str) -> None:
    """Make ``latest`` from all uploads, as after rows of an upload were taken back."""
    base = path.rstrip("/")
    latest = latest_predictions(read_uploads(spark, base)).select(PREDICTIONS.names)
    staged = f"{base}/staged"
    latest.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(staged)
    gone = set(distinct_dates(read_latest(spark, base))) - set(distinct_dates(spark.read.schema(PREDICTIONS).parquet(staged)))
    publish(spark, staged, f"{base}/latest", PREDICTIONS)
    for date in gone:
        remove_path(spark, f"{base}/latest/date={date}")
    remove_path(spark, staged)
