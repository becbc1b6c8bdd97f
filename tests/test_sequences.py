import datetime as dt

import pytest
from pyspark.sql import functions as F

from storeflow.operators import sequences as Q
from storeflow.spec import SalesSpec

SCHEMA = "store string, item string, t timestamp, units double"


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


def hours(spark, *used, store="a"):
    return spark.createDataFrame([(store, "i", at(h), float(h)) for h in used], SCHEMA)


def test_index_counts_hours_over_gaps(spark):
    df = hours(spark, 3, 4, 8).union(hours(spark, 5, store="b"))
    rows = Q.time_index(df, ["store", "item"], "t").orderBy("store", "t").collect()
    assert [r.time_idx for r in rows] == [0, 1, 5, 0]


def test_windows_need_a_full_horizon(spark):
    rows = Q.training_sequences(hours(spark, *range(6)), ["store", "item"], "t", "units", 3, 2).orderBy("t").collect()
    assert [r.history for r in rows] == [[0.0], [0.0, 1.0], [0.0, 1.0, 2.0], [1.0, 2.0, 3.0]]
    assert rows[-1].horizon == [4.0, 5.0]


def test_dense_windows_fill_hours_with_zero(spark):
    rows = Q.training_sequences(
        hours(spark, 1, 4), ["store", "item"], "t", "units", 2, 1, dense=True).orderBy("t").collect()
    assert [(r.t.hour, r.history, r.horizon) for r in rows] == [
        (1, [1.0], [0.0]), (2, [1.0, 0.0], [0.0]), (3, [0.0, 0.0], [4.0])]


def test_roles_that_exist_and_that_do_not(spark):
    df = spark.createDataFrame([("a", "i", 1.5, 2.0)], "store_id string, `Item Slin` string, Latitude double, sales_unit_qty double")
    roles = SalesSpec().roles
    found, absent = Q.role_columns(df, roles)
    assert found["static_categoricals"] == ["store_id", "Item Slin"]
    assert "promotion_id" in absent["time_varying_known_categoricals"] and "zone_name" in absent["static_categoricals"]
    row = Q.role_projection(df, roles, ["store_id"]).first()
    assert row.static_reals.Latitude == 1.5 and "time_varying_unknown_categoricals" not in row


def test_dense_windows_keep_static_columns_within_bounds(spark):
    far = spark.createDataFrame([("a", "i", dt.datetime(2124, 1, 1), 9.0), ("a", "i", None, 9.0)], SCHEMA)
    rows = hours(spark, 1, 4).union(far).withColumn("region", F.lit("north"))
    dense = Q.densify(rows, ["store", "item"], "t", ["units"], ["region"], at(0), at(23)).orderBy("t").collect()
    assert [(r.t.hour, r.units, r.region) for r in dense] == [
        (1, 1.0, "north"), (2, 0.0, "north"), (3, 0.0, "north"), (4, 4.0, "north")]


def test_nulls_keep_their_place(spark):
    rows = spark.createDataFrame([("a", "i", at(h), None if h == 5 else float(h)) for h in range(12)], SCHEMA)
    got = Q.training_sequences(rows, ["store", "item"], "t", "units", 4, 3).orderBy("t").collect()
    assert [r.t.hour for r in got] == list(range(9))
    assert got[6].history == [3.0, 4.0, None, 6.0] and got[3].horizon == [4.0, None, 6.0]


@pytest.mark.parametrize("piece", [1, 3, 10, 1000])
def test_pieces_give_the_windows_of_whole_series(spark, piece):
    """Gaps of days, several rows in an hour, null keys and times."""
    start = dt.datetime(2024, 1, 1)
    rows = [("a", "i", start + dt.timedelta(hours=h * h % 977), float(h % 7)) for h in range(60)]
    rows += [(None, "i", start + dt.timedelta(hours=h), None if h % 5 == 0 else 1.5) for h in range(25)]
    rows += [("a", "i", start, 9.0), ("a", "i", start, 8.0), ("a", "i", None, 1.0), ("b", None, start, 2.0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("region", F.lit("n"))
    options = dict(history=5, horizon=3, static=["region"])
    for measure in ("units", ["units", "t"]):
        plain = Q.training_sequences(frame, ["store", "item"], "t", measure, **options)
        cut = Q.training_sequences(frame, ["store", "item"], "t", measure, piece=piece, **options)
        assert cut.columns == plain.columns
        assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect())) and not plain.isEmpty()


def test_steps_are_numbered_over_gaps(spark):
    rows = [("a", "i", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * h), 0.0) for h in range(500)]
    got = Q.numbered_steps(spark.createDataFrame(rows, SCHEMA), ["store", "item"], "t", [], 24, "at").orderBy("t").collect()
    assert [r["at"] for r in got] == list(range(500))


def test_one_long_series_is_many_tasks(spark, final_plan):
    rows = spark.range(0, 20_000).select(
        F.lit("a").alias("store"), F.lit("i").alias("item"), F.timestamp_seconds(F.col("id") * 3600).alias("t"), F.col("id").cast("double").alias("units"))
    cut = Q.training_sequences(rows, ["store", "item"], "t", "units", 30, 7, piece=500)
    assert "__piece" in final_plan(cut)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = cut.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 20_000 - 7
