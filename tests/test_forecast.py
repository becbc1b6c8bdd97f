import datetime as dt

import pytest
from pyspark.sql import functions as F

from storeflow.functions.accuracy import accuracy_band, accuracy_pct
from storeflow.functions.slots import slot_of, slots
from storeflow.functions.slots import SLOT_LABELS
from storeflow.operators import forecast as P

DAY = dt.date(2024, 1, 20)
PREDICTED = "date date, prediction_slot int, item_type string, item_subtype string, predicted_quantity int"
ACTUAL = "date date, prediction_slot int, item_type string, item_subtype string, actual_quantity int"


@pytest.mark.parametrize("predicted, actual, percent, band", [
    (0, 0, 100.0, "high"), (5, 0, 0.0, "low"), (85, 100, 85.0, "high"), (60, 100, 60.0, "medium"),
    (59, 100, 59.0, "low"), (300, 100, 0.0, "low"), (1, 3, 33.3, "low"), (100, 100, 100.0, "high"),
])
def test_accuracy(spark, predicted, actual, percent, band):
    df = spark.createDataFrame([(predicted, actual)], "p int, a int")
    score = accuracy_pct(F.col("p"), F.col("a"))
    assert tuple(df.select(score, accuracy_band(score)).first()) == (percent, band)


def test_missing_accuracy_is_low(spark):
    assert spark.range(1).select(accuracy_band(F.lit(None).cast("double"))).first()[0] == "low"


def test_slots_of_the_day(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 01:59:59", "2024-01-01 02:00:00", "2024-01-01 23:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(slot_of(F.to_timestamp("t")))
    assert [r[0] for r in df.collect()] == [1, 1, 2, 12]
    last = slots(spark).orderBy(F.col("slot").desc()).first()
    assert (last["slot"], last["start"], last["end"], slots(spark).count()) == (12, "22:00", "24:00", 12)


def test_slot_without_label(spark):
    df = spark.createDataFrame([(1,), (13,), (None,)], "prediction_slot int")
    assert [r.slot_label for r in P.slot_label(df).collect()] == ["12–2 AM", "Slot 13", None]


def test_comparison_keeps_both_sides_and_adds_repeats(spark):
    predicted = spark.createDataFrame([(DAY, 1, "a", "x", 5), (DAY, 2, "a", "x", 7), (DAY, 2, "a", "x", 1)], PREDICTED)
    actual = spark.createDataFrame([(DAY, 2, "a", "x", 4), (DAY, 2, "a", "x", 4), (DAY, 3, "b", "y", 2)], ACTUAL)
    rows = P.compare(predicted, actual).orderBy("prediction_slot").collect()
    assert [(r.predicted_quantity, r.actual_quantity, r.difference) for r in rows] == [(5, 0, 5), (8, 8, 0), (0, 2, -2)]
    assert [r.accuracy_pct for r in rows] == [0.0, 100.0, 0.0]


SCORED = "date date, item_type string, predicted_quantity int, actual_quantity int, difference int, accuracy_pct double"


def test_summary_counts_missing_accuracy_as_zero(spark):
    rows = [(DAY, "a", 5, 4, 1, 75.0), (DAY, "a", 1, 2, -1, None), (DAY, "b", 2, 2, 0, 100.0)]
    row = P.comparison_summary(spark.createDataFrame(rows, SCORED)).first()
    assert row.avg_accuracy == 58.3 and (row.total_predicted, row.total_actual) == (8, 8)
    assert (row.over_predicted, row.under_predicted, row.exact, row.total) == (1, 1, 1, 3)


def test_empty_comparison_has_no_summary(spark):
    assert P.comparison_summary(spark.createDataFrame([], SCORED)).count() == 0


def test_one_month_of_comparisons(spark):
    rows = [(dt.date(2024, m, d), "a", 1, 1, 0, 100.0) for m, d in ((1, 31), (2, 1), (2, 29), (3, 1))]
    df = spark.createDataFrame(rows, SCORED)
    assert P.monthly_comparison(df, "2024-02").first()["total"] == 2
    assert P.monthly_comparison(df).count() == 3


def test_category_filter_is_optional(spark):
    df = spark.createDataFrame([("a",), ("b",)], "item_type string")
    assert P.comparison_by_category(df).count() == 2 and P.comparison_by_category(df, "a").count() == 1


def test_today_is_the_default_day(spark):
    df = spark.range(2).select(F.date_sub(F.current_date(), F.col("id").cast("int")).alias("date"))
    assert P.predictions_by_date(df).count() == 1


def test_totals_by_category_and_subtype(spark):
    rows = [(DAY, 1, "a", "x", 2), (DAY, 1, "a", "y", 3), (DAY, 1, "a", None, 4)]
    df = spark.createDataFrame(rows, PREDICTED)
    got = {(r.level, r.item_subtype): r.total_predicted for r in P.slot_totals(df).collect()}
    assert got == {("category", None): 9, ("subtype", "x"): 2, ("subtype", "y"): 3, ("subtype", None): 4}


def test_nested_payload_and_day_stats(spark):
    rows = [(DAY, 1, "a", "x", 2), (DAY, 1, "a", "x", 1), (DAY, 1, "a", "y", 3), (DAY, 4, "b", "x", 5)]
    df = spark.createDataFrame(rows, PREDICTED)
    rows = P.slot_payload(df).filter("prediction_slot = 1").collect()
    assert {(r.item_subtype, r.quantity, r.total_predicted) for r in rows} == {("x", 3, 6), ("y", 3, 6)}
    stats = P.prediction_stats(df).first()
    assert (stats.total_predicted, stats.active_slots, stats.total_items) == (11, 2, 3)


def test_null_keys_are_one_key(spark):
    predicted = spark.createDataFrame([(DAY, 1, "a", None, 2), (DAY, 1, "a", None, 1)], PREDICTED)
    sold = PREDICTED.replace("predicted", "actual")
    actual = spark.createDataFrame([(DAY, 1, "a", None, 3), (DAY, 14, None, "x", 1)], sold)
    got = {(r.item_type, r.predicted_quantity, r.actual_quantity) for r in P.compare(predicted, actual).collect()}
    assert got == {("a", 3, 3), (None, 0, 1)}
    day = P.comparison_by_date(predicted, actual, DAY).collect()
    assert {r.slot_label for r in day} == {SLOT_LABELS[0], "Slot 14"}
    assert P.comparison_by_date(predicted, actual, "2000-01-01").isEmpty()
    payload = P.slot_payload(predicted).collect()
    assert [(r.item_subtype, r.quantity, r.total_predicted) for r in payload] == [(None, 3, 3)]


def test_newest_upload_wins(spark):
    schema = PREDICTED + ", model_version string, uploaded_at timestamp"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(DAY, 1, "a", "x", 9, "m1", new), (DAY, 1, "a", "x", 5, "m2", old), (DAY, 2, "a", "x", 1, "m2", old)]
    got = P.latest_predictions(spark.createDataFrame(rows, schema)).orderBy("prediction_slot").collect()
    assert [(r.predicted_quantity, r.model_version) for r in got] == [(9, "m1"), (1, "m2")]
