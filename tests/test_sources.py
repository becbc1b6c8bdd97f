import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F
from rows import frame, sale

from storeflow import session
from storeflow.jobs import build_features, clean_sales
from storeflow.jobs.config import load_config
from storeflow.sources import tables as S
from storeflow.sources import uploads as P


@pytest.fixture
def schema(spark, tmp_path):
    name = f"s_{uuid.uuid4().hex[:8]}"
    S.ensure_schema(spark, name, location=str(tmp_path / name))
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def test_csv_is_text_unless_asked(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as out:
        out.write("store_id,units,day\n007,3,2024-01-02\n008,x,bad\n")
    assert dict(S.read_sales_csv(spark, path).dtypes) == {"store_id": "string", "units": "string", "day": "string"}
    typed = S.read_sales_csv(spark, path, {"units": "int", "day": "date", "absent": "int"})
    assert [tuple(r) for r in typed.collect()] == [("007", 3, dt.date(2024, 1, 2)), ("008", None, None)]
    assert dict(S.read_sales_csv(spark, path, infer=True).dtypes)["store_id"] == "int"


def test_headers_are_never_mixed_up(spark, tmp_path):
    for name, text in (("x", "a,b\n1,2\n"), ("y", "b,a\n2,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(Exception, match="header"):
        S.read_sales_csv(spark, str(tmp_path)).collect()
    rows = S.read_sales_csv(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")])
    assert [tuple(r) for r in rows.collect()] == [("1", "2"), ("1", "2")]


def test_lines_of_the_wrong_length_are_kept(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    rows = S.read_sales_csv(spark, str(tmp_path / "in.csv"), keep_corrupt=True)
    assert [(r.a, r[S.CORRUPT]) for r in rows.collect()] == [("1", None), ("3", "3"), ("4", "4,5,6")]


def test_overwrite_replaces_rows_and_columns(spark, schema):
    S.overwrite_table(spark.range(5), schema, "t")
    S.overwrite_table(spark.range(2).select(F.col("id").alias("Item Slin")), schema, "t", rebalance=True)
    got = S.read_table(spark, schema, "t")
    assert got.columns == ["Item Slin"] and got.count() == 2


def test_list_and_copy(spark, schema, tmp_path):
    S.overwrite_table(spark.range(5), schema, "a")
    S.overwrite_table(spark.range(7), schema, "b")
    spark.range(1).createOrReplaceTempView("not_a_table")
    target = f"{schema}_copy"
    S.ensure_schema(spark, target, location=str(tmp_path / target))
    S.overwrite_table(spark.range(1), target, "a")
    report = S.copy_schema(spark, [schema], [target])
    assert [tuple(r) for r in report.orderBy("table_name").collect()] == [("a", 5), ("b", 7)]
    assert {tuple(r) for r in S.table_inventory(spark, target).collect()} == {("a", 5), ("b", 7)}
    spark.sql(f"DROP SCHEMA {target} CASCADE")


def test_append_and_clear(spark, schema):
    S.append_rows(spark.range(3), schema, "t")
    S.clear_table(spark, schema, "t")
    assert S.read_table(spark, schema, "t").count() == 0
    S.append_rows(spark.range(2), schema, "t")
    assert S.read_table(spark, schema, "t").count() == 2


def test_catalogue_is_flattened(spark):
    row = ("c1", "Pizza", [("s1", "Plain"), ("s2", "Hot")])
    df = spark.createDataFrame([row, ("c2", "Empty", [])],
                               "id string, name string, subtypes array<struct<id:string,name:string>>")
    assert [tuple(r) for r in S.item_catalogue(df).collect()] == [
        ("c1", "Pizza", "s1", "Plain"), ("c1", "Pizza", "s2", "Hot")]


def test_names_are_quoted():
    assert S.qualified("cat", "raw-data", "a`b") == "`cat`.`raw-data`.`a``b`"
    assert S.qualified("", "s", "t") == "`s`.`t`"


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_config_files(tmp_path):
    (tmp_path / "c.json").write_text('{"target": "units"}')
    assert load_config(str(tmp_path / "c.json")) == {"target": "units"}


def test_jobs_from_csv_to_features(spark, schema, tmp_path):
    rows = [sale(row_id=n, store_id=f"s{n % 3}", time=f"2024-03-0{1 + n % 5} 1{n % 3}:00:00", units=float(n),
                 promo=("p1", "p 2", None)[n % 3], gross=str(n * 2)) for n in range(1, 40)]
    raw = str(tmp_path / "raw")
    frame(spark, *rows).drop("row_id").write.csv(raw, header=True)
    config = {
        "training_data_location": {"dataset": raw}, "transformed_target_table": "clean",
        "schemas": {"base": schema, "processed": schema}, "target": "sales_unit_qty",
        "Features": {
            "numerical": ["Gross_sales", "avg_sell_price", "promo_quantity", "promo_amount", "Latitude"],
            "drop_columns": ["State", "month"],
            "date_time_features": {"transaction_timestamp": {"extract": ["hour", "quarter"]}},
            "categorical_encoding": {
                "method": "label", "columns": ["store_id", "Item Slin", "cat_id", "promotion_id"],
                "fill_na": {"Holidays": "No_Holiday", "promo_amount": 0},
                "binary_encoding": {"map": {"Y": 1, "N": 0}, "columns": ["PERISHABLE"]},
            },
            "tft_covariates": {"transformations": {
                "target_scaling": {"method": "log1p", "column": "sales_unit_qty"},
                "numerical_scaling": {"method": "standard", "columns": ["Gross_sales", "Latitude"]}}},
        },
    }
    report = clean_sales.run(spark, config)
    assert report.filter("rejected > 0").count() == 0
    clean = S.read_table(spark, schema, "clean")
    assert {"feature_promo_null", "feature_promo_P1", "feature_promo_P 2"} <= set(clean.columns)
    assert clean.agg(F.sum("sales_unit_qty")).first()[0] == sum(range(1, 40))
    build_features.run(spark, config)
    final = S.read_table(spark, schema, "clean_final")
    assert final.count() == clean.count()
    assert dict(final.dtypes)["Item Slin"] == "int" and dict(final.dtypes)["PERISHABLE"] == "int"
    assert final.agg(F.abs(F.avg("Gross_sales"))).first()[0] < 1e-9
    assert S.read_table(spark, schema, "clean_scaler").count() == 3
    before = {tuple(r) for r in final.select("Item Slin", "store_id", "sales_unit_qty").collect()}
    build_features.run(spark, config, refit=False)
    after = S.read_table(spark, schema, "clean_final").select("Item Slin", "store_id", "sales_unit_qty")
    assert {tuple(r) for r in after.collect()} == before


def test_a_broken_table_does_not_end_a_copy(spark, tmp_path):
    source, target = (f"s_{uuid.uuid4().hex[:8]}" for _ in range(2))
    S.ensure_schema(spark, source)
    for name in ("a", "b", "c"):
        S.overwrite_table(spark.range(10).withColumnRenamed("id", name), source, name)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no parquet")
    spark.sql(f"CREATE TABLE {source}.bad (x INT) USING parquet LOCATION '{tmp_path}/bad'")
    for parallel in (1, 8):
        report = {r.table_name: (r.rows, r.error) for r in S.copy_report(spark, [source], [target], parallel=parallel).collect()}
        assert {n: rows for n, (rows, _) in report.items()} == {"a": 10, "b": 10, "c": 10, "bad": None}
        assert report["bad"][1] and report["a"][1] is None
    assert S.read_table(spark, target, "c").count() == 10
    with pytest.raises(RuntimeError, match="not copied: bad"):
        S.copy_schema(spark, [source], [target])
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_a_folder_with_several_headers(spark, tmp_path):
    files = {
        "1.csv": "a,b\n1,x\n2,y\n", "2.csv": "b,a\nz,3\n", "3.csv": 'a,"c,d"\n4,"q r"\n', "4.csv": "a,b\n5,w\n",
        "5.csv": "", "sub/6.csv": "b\nv\n", "note.txt": "not,csv\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    headers = S.csv_headers(spark, str(tmp_path), "*.csv")
    assert {h: len(f) for h, f in headers.items()} == {("a", "b"): 2, ("b", "a"): 1, ("a", "c,d"): 1, ("b",): 1}
    rows = S.read_mixed_csv(spark, str(tmp_path), {"a": "int"}, "*.csv")
    assert rows.columns == ["a", "b", "c,d"]
    got = sorted(map(str, (tuple(r) for r in rows.where("a is null or a <> 4").collect())))
    assert got == ["(1, 'x', None)", "(2, 'y', None)", "(3, 'z', None)", "(5, 'w', None)", "(None, 'v', None)"]
    assert rows.where("a = 4").count() == 1
    with pytest.raises(ValueError, match="no file"):
        S.read_mixed_csv(spark, str(tmp_path), pattern="*.none")


def predicted(spark, *rows):
    schema = "date string, prediction_slot int, item_type string, item_subtype string, predicted_quantity int, model_version string, uploaded_at string"
    frame = spark.createDataFrame([(d, slot, "a", "b", q, v, t) for d, slot, q, v, t in rows], schema)
    return frame.withColumn("date", F.to_date("date")).withColumn("uploaded_at", F.to_timestamp("uploaded_at"))


def test_the_latest_predictions_are_a_scan(spark, tmp_path, final_plan):
    path = str(tmp_path / "predictions")

    def latest():
        return {(r.date.day, r.prediction_slot): (r.predicted_quantity, r.model_version) for r in P.read_latest(spark, path).collect()}

    first = predicted(spark, ("2024-05-01", 1, 5, "m1", "2024-04-30"), ("2024-05-02", 1, 6, "m1", "2024-04-30"))
    newer = predicted(spark, ("2024-05-01", 1, 7, "m2", "2024-05-01"), ("2024-05-01", 2, 8, "m2", "2024-05-01"))
    older = predicted(spark, ("2024-05-02", 1, 9, "m0", "2024-04-01"), ("2024-05-03", 1, 1, "m0", "2024-04-01"))
    for name, rows in (("first", first), ("newer", newer), ("older", older), ("first", first)):
        before = set(P.read_latest(spark, path).inputFiles()) if name == "newer" else set()
        P.upload(rows, path, name)
        assert {f for f in before if "date=2024-05-01" not in f} <= set(P.read_latest(spark, path).inputFiles())
    expected = {(1, 1): (7, "m2"), (1, 2): (8, "m2"), (2, 1): (6, "m1"), (3, 1): (1, "m0")}
    assert latest() == expected and P.read_uploads(spark, path).count() == 6
    plan = final_plan(P.read_latest(spark, path, [dt.date(2024, 5, 1)]))
    assert "Exchange" not in plan and "2024-05-01" in plan.split("PartitionFilters")[1]
    session.remove_path(spark, f"{path}/uploads/upload=older")
    P.rebuild_latest(spark, path)
    assert latest() == {k: v for k, v in expected.items() if k != (3, 1)}
    with pytest.raises(Exception, match="no date"):
        P.upload(predicted(spark, (None, 1, 5, "m1", "2024-04-30")), path, "bad")
