import dataclasses
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from rows import frame, sale

from storeflow.operators import cleaning as K
from storeflow.operators import hourly as H
from storeflow.plans.cleaning import clean_hourly_sales
from storeflow.spec import SalesSpec

SPEC = SalesSpec(row_id="row_id")


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_drops_listed_columns_that_exist(spark):
    df = K.drop_configured(frame(spark, sale()), SPEC.drop_columns)
    assert "State" not in df.columns and "month" not in df.columns and "cat_id" in df.columns


def test_normalise_makes_text_upper_and_trimmed(spark):
    df = spark.createDataFrame([(7, " a b ", None)], "store_id int, cat_id string, City string")
    assert tuple(only(K.normalise_categoricals(df, SPEC.categorical_columns))) == ("7", "A B", None)


def test_bad_values_become_null_under_ansi(spark):
    df = frame(spark, sale(time="soon", day="31.12.2024", gross="n/a"))
    row = only(K.typed_rows(df, SPEC))
    assert row.transaction_timestamp is None and row.day_date is None and row.Gross_sales is None


def test_report_counts_rejected_values_and_names_absent_columns(spark):
    df = frame(spark, sale(time="soon", gross="x"), sale(gross="y", day=None), sale())
    report = {(r["column"], r["expected_by"]): (r["present"], r["rejected"])
              for r in K.column_report(df, SPEC).collect()}
    assert report["transaction_timestamp", "timestamp"] == (True, 1)
    assert report["Gross_sales", "numeric"] == (True, 2)
    assert report["day_date", "date"] == (True, 0)
    assert report["MAX_PRES", "numeric"] == (False, 0)
    assert report["zone_name", "drop"] == (False, 0)


@pytest.mark.parametrize("value, kept", [(0.0, True), (2.0, True), (-0.5, False), (None, False)])
def test_target_gate_removes_negative_and_null(spark, value, kept):
    df = spark.createDataFrame([(value,)], "sales_unit_qty double")
    assert (K.gate_not_negative(df, "sales_unit_qty").count() == 1) is kept


def test_price_gate_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (3.0,)], "avg_sell_price double")
    assert K.gate_not_negative(df, "avg_sell_price", keep_null=True).count() == 2


def test_fills_only_where_types_agree(spark):
    df = spark.createDataFrame([(None, None, math.nan)], "Holidays string, promo_amount string, promo_quantity double")
    row = only(K.fill_configured(df, SPEC.fills))
    assert row.Holidays == "No_Holiday" and row.promo_amount is None and row.promo_quantity == 0.0


def test_unknown_skips_columns_with_their_own_rule(spark):
    df = spark.createDataFrame([(None, None, None)], "Holidays string, City string, Latitude double")
    assert tuple(only(K.fill_unknown(df, SPEC.categorical_columns, SPEC.fills))) == (None, "UNKNOWN", None)


def test_hourly_policies(spark):
    df = frame(
        spark,
        sale(row_id=1, time="2024-03-02 10:59:59", units=1.0, gross="2", price=2.0, name=None, latitude=None),
        sale(row_id=2, time="2024-03-02 10:00:00", units=2.0, gross="3", price=4.0, name=None, latitude=9.0),
        sale(row_id=3, time="2024-03-02 10:30:00", units=4.0, gross="5", price=None, name="roll"),
        sale(row_id=4, time="2024-03-02 11:00:00", units=8.0, gross="7"),
    )
    rows = H.hourly_agg(K.typed_rows(df, SPEC), SPEC).orderBy("transaction_timestamp").collect()
    ten, eleven = rows
    assert ten.transaction_timestamp == dt.datetime(2024, 3, 2, 10)
    assert (ten.sales_unit_qty, ten.Gross_sales, ten.avg_sell_price) == (7.0, 10.0, 3.0)
    assert ten.ITEM_NAME == "ROLL" and ten.Latitude == 9.0
    assert eleven.sales_unit_qty == 8.0
    assert "promotion_id" not in rows[0] and "row_id" not in rows[0]


def test_first_value_ties_follow_row_id_else_the_value(spark):
    rows = (sale(row_id=2, name="b"), sale(row_id=1, name="c"), sale(row_id=3, name="a"))
    typed = K.typed_rows(frame(spark, *rows), SPEC)
    assert only(H.hourly_agg(typed, SPEC)).ITEM_NAME == "C"
    assert only(H.hourly_agg(typed.drop("row_id"), SalesSpec())).ITEM_NAME == "A"


def test_promotions_with_null_value_and_empty_cells(spark):
    df = frame(
        spark,
        sale(row_id=1, promo=None, promo_quantity=5.0),
        sale(row_id=2, promo="p1", promo_quantity=None),
        sale(row_id=3, promo="p2", promo_quantity=2.0),
        sale(row_id=4, promo="p2", promo_quantity=3.0),
    )
    row = only(H.hourly_sales(K.typed_rows(df, SPEC), SPEC))
    assert (row.feature_promo_null, row.feature_promo_P1, row.feature_promo_P2) == (5.0, 0.0, 5.0)


def odd_rows(spark):
    """Null keys, null times, null promotions, blanks around keys."""
    return frame(
        spark,
        sale(row_id=1, store_id=" s1 "), sale(row_id=2, store_id="S1", promo="p2"),
        sale(row_id=3, store_id=None, promo="p2"), sale(row_id=4, store_id=None, promo=None),
        sale(row_id=5, time="never"), sale(row_id=6, item=None), sale(row_id=7, promo_quantity=None),
        sale(row_id=8, time="2024-03-02 12:00:00", promo=None, promo_quantity=2.5),
    )


def test_one_pass_equals_two_aggregates_and_a_join(spark):
    typed = K.typed_rows(odd_rows(spark), SPEC)
    one, two = H.hourly_sales(typed, SPEC), H.promo_left_join(typed, SPEC)
    assert sorted(one.columns) == sorted(two.columns)
    two = two.select(one.columns)
    assert one.count() == two.count()
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_null_keys_are_kept_named_and_have_null_promotions(spark):
    cleaned = clean_hourly_sales(odd_rows(spark), SPEC)
    unknown = only(cleaned.filter("store_id = 'UNKNOWN'"))
    assert unknown.sales_unit_qty == 2.0 and unknown.feature_promo_P2 is None
    assert cleaned.filter("store_id = 'S1' and `Item Slin` = 'I1'").count() == 3


def test_any_number_of_promotions_keeps_the_column_order(spark):
    rows = [sale(promo=f"P{n:03}", time=f"2024-03-02 1{n % 3}:15:00", promo_quantity=float(n)) for n in range(201)]
    typed = K.typed_rows(frame(spark, *rows), SPEC)
    wide = H.hourly_sales(typed, SPEC)
    few = H.hourly_sales(typed.filter("promotion_id < 'P003'"), SPEC)
    promos = [c for c in wide.columns if c.startswith(H.PROMO_PREFIX)]
    assert len(promos) == 201
    assert [c for c in wide.columns if c not in promos] == [c for c in few.columns if not c.startswith(H.PROMO_PREFIX)]
    assert wide.columns[-1] == few.columns[-1] == SPEC.time_column
    total = typed.agg(F.sum("promo_quantity")).first()[0]
    assert sum(sum(r[c] for c in promos) for r in wide.collect()) == total
    mapped = H.hourly_sales(typed, SPEC, form="map").select(F.explode(H.PROMO_MAP))
    assert mapped.agg(F.sum("value")).first()[0] == total
    assert H.promo_totals(typed, SPEC).agg(F.sum("promo_quantity")).first()[0] == total
    assert not any(c.startswith(H.PROMO_PREFIX) for c in H.hourly_sales(typed, SPEC, form="rows").columns)


def test_unlisted_promotions_are_never_lost(spark):
    rows = frame(spark, sale(promo="click"), sale(promo=" view"), sale(promo=None))
    with pytest.raises(Exception, match="not listed"):
        clean_hourly_sales(rows, SPEC, ["Click"]).collect()
    got = only(clean_hourly_sales(rows, SPEC, ["Click", None], unlisted="column"))
    quantity = only(clean_hourly_sales(rows, SPEC, ["click", "view", None]))
    assert got.feature_promo_CLICK == quantity.feature_promo_CLICK == 1.0
    assert got.feature_promo_other == quantity.feature_promo_VIEW and got.feature_promo_null == quantity.feature_promo_null


def test_keys_that_are_dropped_are_named(spark):
    spec = dataclasses.replace(SPEC, drop_columns=("store_id",))
    with pytest.raises(ValueError, match="store_id"):
        clean_hourly_sales(frame(spark, sale()), spec, ["P1"])


def test_gates_run_before_fills(spark):
    df = frame(spark, sale(units=None), sale(item="i2", gross="bad"), sale(item="i3", price=None),
               sale(item="i4", gross="-1"))
    row = only(clean_hourly_sales(df, SPEC, ["P1"]))
    assert row["Item Slin"] == "I3" and row.Holidays == "No_Holiday" and row.event_name_1 == "No_Event"


def test_missing_keys_raise(spark):
    with pytest.raises(ValueError, match="store_id"):
        clean_hourly_sales(frame(spark, sale()).drop("store_id"), SPEC)


def test_integer_promotions_name_columns(spark):
    df = frame(spark, sale(promo="7")).withColumn("promotion_id", F.col("promotion_id").cast("int"))
    spec = SalesSpec(row_id="row_id", categorical_columns=("store_id",))
    typed = K.typed_rows(df, spec)
    assert only(H.hourly_sales(typed, spec)).feature_promo_7 == 1.0
    assert only(H.promo_pivot(typed, spec)).feature_promo_7 == 1.0


def test_spec_from_nested_config():
    config = {
        "target": "units", "group_ids": ["shop", "sku"],
        "Features": {
            "numerical": ["a"], "drop_columns": ["d"],
            "date_time_features": {"t": {"extract": ["hour", "year"]}},
            "categorical_encoding": {
                "method": "label", "columns": ["c"], "fill_na": {"c": "none"},
                "binary_encoding": {"map": {"Y": 1, "N": 0}, "columns": ["f"]},
            },
            "tft_covariates": {
                "static_reals": ["a"],
                "transformations": {
                    "target_scaling": {"method": "log1p", "column": "units"},
                    "numerical_scaling": {"method": "standard", "columns": ["a", "f", "a"]},
                },
            },
            "training": {"max_encoder_length": 12, "max_prediction_length": 3},
        },
    }
    spec = SalesSpec.from_config(config)
    assert spec.group_keys == ("shop", "sku") and spec.sum_columns[0] == "units"
    assert spec.features_to_scale == ("a", "units") and spec.log_target and spec.truthy == ("Y",)
    assert (spec.history, spec.horizon) == (12, 3) and spec.roles == {"static_reals": ("a",)}
    assert spec.calendar == {"t": ("hour", "year")} and spec.fills == {"c": "none"}


def test_the_text_null_is_not_null(spark):
    rows = frame(spark, sale(promo="null", promo_quantity=1.0), sale(promo=None, promo_quantity=2.0),
                 sale(promo="'null'", promo_quantity=4.0), sale(promo="NULL ", promo_quantity=8.0))
    wide = H.hourly_sales(rows, SPEC, [None, "null", "'null'"], unlisted="column").first().asDict()
    named = {n: v for n, v in wide.items() if n.startswith("feature_promo_")}
    assert named == {"feature_promo_null": 2, "feature_promo_'null'": 1, "feature_promo_''null''": 4, "feature_promo_other": 8}
    mapped = H.hourly_sales(rows, SPEC, form="map").first()[H.PROMO_MAP]
    assert mapped == {"null": 2, "'null'": 1, "''null''": 4, "NULL ": 8}


def test_promotions_that_differ_in_case_are_refused_as_columns(spark):
    rows = frame(spark, sale(promo="ab"), sale(promo="AB"))
    for make in (H.hourly_sales, H.promo_pivot, H.promo_left_join):
        with pytest.raises(ValueError, match="'AB' and 'ab'"):
            make(rows, SPEC)
    assert set(H.hourly_sales(rows, SPEC, form="map").first()[H.PROMO_MAP]) == {"ab", "AB"}
    with pytest.raises(ValueError, match="other"):
        H.hourly_sales(rows, SPEC, ["Other", "ab"], unlisted="column")
