import datetime as dt
import math

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from storeflow.functions.calendar import is_weekend
from storeflow.operators import labels as L
from storeflow.operators import scaling as Z
from storeflow.operators.features import add_calendar, binary_flags
from storeflow.plans.features import fit_features, model_features
from storeflow.spec import SalesSpec


def test_calendar_of_one_moment(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 31, 23, 59, 59),)], "t timestamp")
    parts = ("hour", "dayofweek", "dayofmonth", "month", "quarter", "year", "weekofyear", "isweekend")
    row = add_calendar(df, {"t": parts, "absent": ("hour",)}).first().asDict()
    assert row["t_quarter"] == 4 and row["t_year"] == 2020 and row["t_isweekend"] == 0
    assert "t_hour" not in row and "t_weekofyear" not in row
    assert math.isclose(row["t_hour_sin"], math.sin(2 * math.pi * 23 / 24))
    assert math.isclose(row["t_weekofyear_cos"], math.cos(2 * math.pi * 53 / 52))
    assert math.isclose(row["t_dayofmonth_sin"], math.sin(2 * math.pi), abs_tol=1e-9)


def test_weekend_and_null_dates(spark):
    days = [(dt.date(2024, 3, 2),), (dt.date(2024, 3, 3),), (dt.date(2024, 3, 4),), (None,)]
    df = spark.createDataFrame(days, "d date")
    assert [r[0] for r in df.select(is_weekend(F.col("d"))).collect()] == [1, 1, 0, 0]


def test_flags(spark):
    df = spark.createDataFrame([(" y ", 1), ("N", 0), ("X", 1), (None, None)], "PERISHABLE string, snap_CA int")
    strict = [tuple(r) for r in binary_flags(df, ("PERISHABLE", "snap_CA", "Metro")).collect()]
    assert strict == [(1, 0), (0, 0), (0, 0), (0, 0)]
    digits = [tuple(r) for r in binary_flags(df, ("PERISHABLE", "snap_CA"), ("Y", "1")).collect()]
    assert digits == [(1, 1), (0, 0), (0, 1), (0, 0)]


def test_scaling_centres_constant_and_single_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = [tuple(r) for r in Z.standard_scale(df, ["a", "b", "absent"]).collect()]
    assert rows[0][1] == rows[1][1] == 0.0 and math.isclose(rows[1][0], 1 / math.sqrt(2))
    assert tuple(Z.standard_scale(df.limit(1), ["a"]).first()) == (0.0, 5.0)


def test_nan_can_be_left_out_of_the_statistics(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (math.nan,)], "a double")
    assert math.isnan(Z.fit_scaler(df, ["a"]).first()["mean"])
    assert Z.fit_scaler(df, ["a"], skip_nan=True).first()["mean"] == 2.0


def test_scaler_survives_storage_and_inverts(spark, tmp_path):
    df = spark.range(50).select((F.col("id") * 1.5).alias("a"), F.lit(2.0).alias("b"))
    path = str(tmp_path / "scaler")
    Z.fit_scaler(df, ["a", "b"]).write.parquet(path)
    scaler = spark.read.parquet(path)
    back = Z.undo_scaler(Z.apply_scaler(df, scaler, ["a", "b"]), scaler, ["a", "b"])
    for got, wanted in zip(back.collect(), df.collect(), strict=True):
        assert math.isclose(got.a, wanted.a, abs_tol=1e-9) and got.b == wanted.b


def test_labels_by_frequency_then_text(spark):
    df = spark.createDataFrame([(v,) for v in (10, 9, 2, 2, None)], "n int")
    labels = L.fit_labels(df, ["n"])
    assert {r["value"]: r["idx"] for r in labels.collect()} == {"2": 0, "10": 1, "9": 2}
    assert {r["n_labels"] for r in labels.collect()} == {3}


def test_unseen_and_null_get_the_number_of_labels(spark):
    seen = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "c string, d string")
    labels = L.fit_labels(seen, ["c", "d"])
    new = spark.createDataFrame([("b", "zzz"), (None, "x"), ("a", None)], "c string, d string")
    assert [tuple(r) for r in L.apply_labels(new, labels, ["c", "d"]).collect()] == [(1, 2), (2, 0), (0, 2)]


def test_a_column_of_nulls_encodes_as_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "c string, d string")
    assert {r.d for r in L.label_encode(df, ["c", "d"]).collect()} == {0}


def test_matches_string_indexer_on_many_labels(spark):
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 613 % 97).cast("string").alias("c"), (F.col("id") % 1300).cast("int").alias("d")
    )
    indexer = StringIndexer(inputCols=["c", "d"], outputCols=["ci", "di"], handleInvalid="keep").fit(df)
    expected = indexer.transform(df).groupBy("ci", "di").count().select(
        F.col("ci").cast("int").alias("c"), F.col("di").cast("int").alias("d"), "count")
    got = L.label_encode(df, ["c", "d"]).groupBy("c", "d").count()
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_numbering_is_dense_over_many_range_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select((F.col("id") % 1111).cast("string").alias("a"), F.lit("k").alias("b"))
        labels = L.fit_labels(df, ["a", "b"]).filter("column = 'a'").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    ranked = sorted(labels, key=lambda r: (-r["n"], r["value"]))
    assert [r["idx"] for r in ranked] == list(range(1111))


SPEC = SalesSpec(
    group_keys=("store_id", "item"), categorical_columns=("store_id", "promotion_id"), flag_columns=("PERISHABLE",),
    scaled_columns=("Gross_sales", "PERISHABLE"), calendar={"transaction_timestamp": ("hour", "year")},
)


def hourly(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), float(h), 2.0 * h, "Y") for h in range(4)]
    rows.append(("b", dt.datetime(2024, 1, 1, 9), 0.0, 1.0, "N"))
    return spark.createDataFrame(
        rows, "store_id string, transaction_timestamp timestamp, sales_unit_qty double, Gross_sales double, PERISHABLE string")


def test_feature_table(spark):
    made = model_features(hourly(spark), SPEC).orderBy("transaction_timestamp").collect()
    assert [r.store_id for r in made] == [0, 0, 0, 0, 1]
    assert [r.PERISHABLE for r in made] == [1, 1, 1, 1, 0]
    assert made[0].transaction_timestamp_year == 2024
    logs = [math.log1p(v) for v in (0.0, 1.0, 2.0, 3.0, 0.0)]
    mean = sum(logs) / 5
    std = math.sqrt(sum((x - mean) ** 2 for x in logs) / 4)
    assert made[2].sales_unit_qty == pytest.approx((logs[2] - mean) / std)
    assert sum(r.Gross_sales for r in made) == pytest.approx(0.0, abs=1e-9)


def test_stored_fit_treats_new_rows_like_old_ones(spark):
    scaler, labels = fit_features(hourly(spark), SPEC)
    new = hourly(spark).filter("store_id = 'b'").withColumn("store_id", F.lit("c"))
    row = model_features(new, SPEC, scaler, labels).first()
    whole = model_features(hourly(spark), SPEC).filter("store_id = 1").first()
    assert row.store_id == 2 and row.Gross_sales == pytest.approx(whole.Gross_sales)


def test_flag_map_values_and_their_order():
    def spec(flags, **more):
        return SalesSpec.from_config({"Features": {"categorical_encoding": {"binary_encoding": {"map": flags, **more}}}})

    assert (spec({"N": 0, "Y": 1}).truthy, spec({"N": 0, "Y": 1}).flag_values) == (("N",), (0, 1))
    assert (spec({"Y": 1, "N": 0}).truthy, spec({"Y": 1, "N": 0}).flag_values) == (("Y",), (1, 0))
    assert spec({"Y": 1}, truthy=["Y", 1]).truthy == ("Y", "1")


def test_flags_are_never_scaled_and_the_log_has_its_own_column():
    covariates = {"transformations": {
        "numerical_scaling": {"method": "standard", "columns": ["snap_CA", "PERISHABLE", "x"]},
        "target_scaling": {"method": "log1p", "column": "x"}}}
    spec = SalesSpec.from_config({"target": "y", "row_id": "id", "time_column": "t", "date_columns": ["d"],
                                  "Features": {"tft_covariates": covariates}})
    assert spec.features_to_scale == ("x", "y") and spec.log_column == "x" and spec.log_target
    assert (spec.row_id, spec.time_column, spec.date_columns) == ("id", "t", ("d",))


def test_unfitted_columns_fail_by_name(spark):
    rows = spark.createDataFrame([(1.0, "a", "u"), (3.0, "b", "v")], "x double, c string, d string")
    scaler = Z.fit_scaler(rows, ["x"])
    with pytest.raises(Exception, match="no column y"):
        Z.apply_scaler(rows.withColumn("y", F.col("x")), scaler, ["x", "y"]).collect()
    labels = L.fit_labels(rows, ["c"])
    with pytest.raises(Exception, match="no column d"):
        L.apply_labels(rows, labels, ["c", "d"]).collect()


def test_distinct_combinations_give_the_same_labels(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 2), (None, None), ("a", 1)], "c string, d int")
    labels = L.fit_labels(rows.limit(5), ["c", "d"])
    more = rows.unionAll(spark.createDataFrame([("new", 7)], "c string, d int"))
    plain = sorted(map(tuple, L.apply_labels(more, labels, ["c", "d"]).collect()))
    assert plain == sorted(map(tuple, L.apply_labels(more, labels, ["c", "d"], distinct_first=True).collect()))


def test_every_way_of_joining_gives_the_same_labels(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 2), (None, None), ("a", 1)], "c string, d int")
    labels = L.fit_labels(rows.limit(5), ["c", "d"])
    more = rows.unionAll(spark.createDataFrame([("new", 7)], "c string, d int"))
    plain = sorted(map(tuple, L.apply_labels(more, labels, ["c", "d"]).collect()))
    for options in ({"large": ["c", "d"]}, {"large": ["d"]}, {"large": []}, {"broadcast_labels": 0}):
        assert plain == sorted(map(tuple, L.apply_labels(more, labels, ["c", "d"], **options).collect()))


def values(spark, *days):
    rows = [(dt.date(2024, 1, d), v, w) for d, v, w in days]
    return spark.createDataFrame(rows, "date date, v double, w double")


DAYS = ((1, 1e9 + 1, None), (1, 1e9 + 2, 5.0), (2, 1e9 + 4, None), (3, 1e9 + 3, 7.0), (3, 1e9 + 9, 7.0), (3, None, 8.0))


def scaler(frame):
    return {r.feature: (r["mean"], r["std"]) for r in frame.collect()}


def test_moments_of_parts_give_the_scaler_of_all_rows(spark):
    rows = values(spark, *DAYS)
    expected = scaler(Z.fit_scaler(rows, ["v", "w"]))
    for by in ((), ("date",)):
        got = scaler(Z.moments_scaler(Z.moments(rows, ["v", "w"], by)))
        for name, (mean, std) in expected.items():
            assert got[name] == (pytest.approx(mean, rel=1e-12), pytest.approx(std, rel=1e-9))
    one = scaler(Z.moments_scaler(Z.moments(rows.limit(1), ["v", "w"])))
    assert one["v"][1] is None and one["w"] == (None, None)


def test_moments_skip_nan_or_carry_it(spark):
    rows = values(spark, (1, float("nan"), 1.0), (2, 3.0, 1.0), (2, 5.0, 1.0))
    assert math.isnan(scaler(Z.moments_scaler(Z.moments(rows, ["v"], ["date"])))["v"][0])
    assert scaler(Z.moments_scaler(Z.moments(rows, ["v"], ["date"], skip_nan=True)))["v"] == (4.0, pytest.approx(2**0.5))


def test_new_days_extend_stored_moments(spark, tmp_path):
    path = str(tmp_path / "moments")
    rows = values(spark, *DAYS)
    # Day 3 comes in two parts, day 2 after it.
    for part in (values(spark, *DAYS[:2]), values(spark, *DAYS[3:5]), values(spark, DAYS[2]), values(spark, DAYS[5])):
        Z.add_moments(part, ["v", "w"], path)
    expected = scaler(Z.fit_scaler(rows, ["v", "w"]))
    got = scaler(Z.moments_scaler(Z.read_moments(spark, path)))
    assert all(got[n] == (pytest.approx(m, rel=1e-12), pytest.approx(s, rel=1e-9)) for n, (m, s) in expected.items())
    before = set(spark.read.parquet(path).inputFiles())
    for _ in range(2):
        Z.add_moments(values(spark, (1, 10.0, 1.0), (1, 20.0, 3.0)), ["v", "w"], path, replace=True)
    after = set(spark.read.parquet(path).inputFiles())
    assert {f for f in before if "date=2024-01-01" not in f} <= after
    day = {r.feature: (r.n, r["mean"], r.m2) for r in Z.read_moments(spark, path).where("date = '2024-01-01'").collect()}
    assert day == {"v": (2, 15.0, 50.0), "w": (2, 2.0, 2.0)}
