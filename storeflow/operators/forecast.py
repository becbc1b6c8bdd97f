"""Predictions per day and slot, and how they compare with actual sales.

Tables: predictions(date, prediction_slot, item_type, item_subtype,
predicted_quantity, model_version, uploaded_at) and actuals(date,
prediction_slot, item_type, item_subtype, actual_quantity).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeflow.functions.accuracy import accuracy_band, accuracy_pct, difference
from storeflow.functions.slots import slot_of, slots

KEYS = ["date", "prediction_slot", "item_type", "item_subtype"]


def _day(date: dt.date | str | None) -> Column:
    """The given day, or today in UTC."""
    if date is None:
        return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    return F.lit(str(date)).cast("date")


def predictions_by_date(predictions: DataFrame, date: dt.date | str | None = None) -> DataFrame:
    """One day's predictions. On a table partitioned by date this prunes partitions."""
    return predictions.filter(F.col("date") == _day(date))


def predictions_by_slot(predictions: DataFrame, slot: int, date: dt.date | str | None = None) -> DataFrame:
    return predictions_by_date(predictions, date).filter(F.col("prediction_slot") == slot)


def predictions_by_category(
    predictions: DataFrame, category: str, date: dt.date | str | None = None
) -> DataFrame:
    return predictions_by_date(predictions, date).filter(F.col("item_type") == category)


def latest_predictions(uploads: DataFrame) -> DataFrame:
    """The newest upload of every key.

    ``max_by`` combines on the map side, so repeated uploads of one key are
    reduced before the shuffle.
    """
    newest = F.max_by(
        F.struct("predicted_quantity", "model_version", "uploaded_at"),
        F.struct("uploaded_at", "model_version", "predicted_quantity"),
    )
    return uploads.groupBy(*KEYS).agg(newest.alias("u")).select(*KEYS, "u.*")


def slot_label(df: DataFrame) -> DataFrame:
    """Add ``slot_label``; slots outside the fixed list show as ``Slot n``."""
    names = F.broadcast(  # always 12 rows
        slots(df.sparkSession).select(F.col("slot").alias("prediction_slot"), "label")
    )
    fallback = F.concat(F.lit("Slot "), F.col("prediction_slot").cast("string"))
    labelled = df.join(names, "prediction_slot", "left")
    return labelled.select(*[F.col(c) for c in df.columns], F.coalesce("label", fallback).alias("slot_label"))


def actuals_by_date(sales: DataFrame) -> DataFrame:
    """Units sold per day, slot and item. ``sales`` has ts, item_type, item_subtype, quantity."""
    keyed = sales.select(
        F.to_date("ts").alias("date"),
        slot_of(F.col("ts")).alias("prediction_slot"),
        "item_type",
        "item_subtype",
        "quantity",
    )
    return keyed.groupBy(*KEYS).agg(F.sum("quantity").alias("actual_quantity"))


def forecast_vs_actual(
    predictions: DataFrame, actuals: DataFrame, date: dt.date | str | None = None
) -> DataFrame:
    """Every key of either side with both quantities; a missing one counts as 0.

    One aggregate over both sides: null is a key like any other, repeated rows
    are added up, and filters on the keys reach both scans. ``date`` picks one
    day; without it all days are compared.
    """
    sides = [
        predictions.select(*KEYS, "predicted_quantity", F.lit(0).alias("actual_quantity")),
        actuals.select(*KEYS, F.lit(0).alias("predicted_quantity"), "actual_quantity"),
    ]
    both = sides[0].unionAll(sides[1]) if date is None else predictions_by_date(sides[0].unionAll(sides[1]), date)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return both.groupBy(*KEYS).agg(total("predicted_quantity"), total("actual_quantity"))


def compare(predictions: DataFrame, actuals: DataFrame, date: dt.date | str | None = None) -> DataFrame:
    """Forecast against actual with difference, accuracy and its band, for one day or all."""
    predicted, actual = F.col("predicted_quantity"), F.col("actual_quantity")
    measured = forecast_vs_actual(predictions, actuals, date).select(
        "*",
        difference(predicted, actual).alias("difference"),
        accuracy_pct(predicted, actual).alias("accuracy_pct"),
    )
    return measured.select("*", accuracy_band(F.col("accuracy_pct")).alias("accuracy_band"))


def comparison_by_date(
    predictions: DataFrame, actuals: DataFrame, date: dt.date | str, category: str | None = None
) -> DataFrame:
    """One day's comparison with the label of each slot, of one category or all."""
    return slot_label(comparison_by_category(compare(predictions, actuals, date), category))


def comparison_by_category(comparison: DataFrame, category: str | None = None) -> DataFrame:
    """One category's rows, or all rows when none is chosen."""
    return comparison if category is None else comparison.filter(F.col("item_type") == category)


def _measures() -> list[Column]:
    off = F.col("difference")
    accuracy = F.coalesce(F.col("accuracy_pct"), F.lit(0.0))
    return [
        F.round(F.avg(accuracy), 1).alias("avg_accuracy"),
        F.sum("predicted_quantity").alias("total_predicted"),
        F.sum("actual_quantity").alias("total_actual"),
        F.count_if(off > 0).alias("over_predicted"),
        F.count_if(off < 0).alias("under_predicted"),
        F.count_if(off == 0).alias("exact"),
        F.count(F.lit(1)).alias("total"),
    ]


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """One row of totals over all categories; none for an empty comparison."""
    return comparison.agg(*_measures()).filter(F.col("total") > 0)


def monthly_comparison(comparison: DataFrame, month: str | None = None) -> DataFrame:
    """The summary measures per month and item type, for one month (``yyyy-MM``) or all."""
    rows = comparison
    if month is not None:
        first = F.to_date(F.lit(f"{month}-01"))
        rows = rows.filter((F.col("date") >= first) & (F.col("date") < F.add_months(first, 1)))
    month_start = F.trunc("date", "month")
    return rows.groupBy(month_start.alias("month"), "item_type").agg(*_measures())


def slot_totals(predictions: DataFrame) -> DataFrame:
    """Units to prepare per day and slot: by category, and by subtype below it.

    Both levels come from one shuffle; category rows have a null subtype and
    ``level`` tells them from real nulls.
    """
    item, sub = F.col("item_type"), F.col("item_subtype")
    day, slot = F.col("date"), F.col("prediction_slot")
    both = predictions.groupingSets([(day, slot, item), (day, slot, item, sub)], day, slot, item, sub)
    return both.agg(
        F.sum("predicted_quantity").alias("total_predicted"),
        F.when(F.grouping("item_subtype") == 1, "category").otherwise("subtype").alias("level"),
    )


def slot_payload(predictions: DataFrame) -> DataFrame:
    """One row per day, slot, category and subtype, with the category's total beside it.

    Rows, not lists: a category may have any number of subtypes, null among them.
    """
    per_subtype = predictions.groupBy(*KEYS).agg(F.sum("predicted_quantity").alias("quantity"))
    category = Window.partitionBy("date", "prediction_slot", "item_type")
    return per_subtype.select("*", F.sum("quantity").over(category).alias("total_predicted"))


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Per day: units predicted, slots in use, and (slot, item, subtype) entries."""
    entries = predictions.groupBy(*KEYS).agg(F.sum("predicted_quantity").alias("q"))
    return entries.groupBy("date").agg(
        F.sum("q").alias("total_predicted"),
        F.count_distinct("prediction_slot").alias("active_slots"),
        F.count(F.lit(1)).alias("total_items"),
    )
