"""Physical plans: shuffles, joins, column pruning, broadcasts, skew."""

import re

import pytest
from pyspark.sql import functions as F

from storeflow.operators import hourly as H
from storeflow.operators import labels as L
from storeflow.operators import pos as S
from storeflow.operators import scaling as Z
from storeflow.operators.features import add_calendar
from storeflow.plans.cleaning import clean_hourly_sales
from storeflow import session
from storeflow.registry import views as V


def exchanges(plan):
    return len(re.findall(r"\bExchange ", plan))


def read_columns(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_cleaning_is_one_shuffle_without_join(spark, small_dir, final_plan):
    plan = final_plan(clean_hourly_sales(V.pos(spark, small_dir), V.POS_SPEC, [p.upper() for p in V.PROMOTIONS]))
    assert exchanges(plan) == 1 and "Join" not in plan and "Python" not in plan


def test_hot_hour_is_combined_before_the_shuffle(spark, small_dir, final_plan):
    plan = final_plan(H.hourly_agg(V.pos(spark, small_dir), V.POS_SPEC))
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_min(" in below and "partial_sum" in below


def test_promotion_sums_are_hash_aggregated(spark, small_dir, final_plan):
    rows = H.keyed_rows(V.pos(spark, small_dir), V.POS_SPEC)
    plan = final_plan(rows.groupBy("store_id", "item_id", H.HOUR).agg(*H.promo_sums(V.POS_SPEC, V.PROMOTIONS)))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and exchanges(plan) == 1


def test_scaling_joins_nothing_and_reads_what_it_needs(spark, small_dir, final_plan):
    rows = V.table(spark, small_dir, "lineitem").select("l_quantity", "l_tax")
    plan = final_plan(Z.standard_scale(rows, ["l_quantity"]))
    assert "Join" not in plan and "Subquery" in plan
    assert sorted(read_columns(plan)) == ["l_quantity:double", "l_quantity:double,l_tax:double"]
    # The statistics are computed once however often they are used.
    assert len(re.findall(r"FileScan", plan)) == 2


def test_small_dictionaries_are_broadcast_by_their_size(spark, small_dir, final_plan):
    rows = V.table(spark, small_dir, "lineitem").select("l_returnflag", "l_linestatus")
    names = ["l_returnflag", "l_linestatus"]
    labels = L.fit_labels(rows, names)
    plan = final_plan(L.apply_labels(rows, labels, names))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_rows_are_shuffled_once_for_several_large_dictionaries(spark, small_dir, final_plan):
    names = ["Item Slin", "ITEM_UNIT", "cat_id", "County", "Flow"]
    rows = V.retail(spark, small_dir).select("l_orderkey", *names, "Gross_sales")
    labels = L.fit_labels(rows, names)
    path = f"{session.fresh_path(spark, 'retail')}"
    rows.write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(L.apply_labels(spark.read.parquet(path), labels, names))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Only the join of the rows carries columns that are not labelled.
    fact = [line for line in plan.splitlines() if "Exchange " in line and "__keys" in line]
    assert len(fact) == 1 and "Broadcast" not in plan
    assert len(re.findall(r"(?:SortMerge|ShuffledHash)Join", plan)) == len(names) + 1


def test_large_dictionaries_are_not_broadcast(spark, small_dir, final_plan):
    rows = V.table(spark, small_dir, "lineitem").select("l_returnflag", "l_linestatus")
    labels = L.fit_labels(rows, ["l_returnflag"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(L.apply_labels(rows, labels, ["l_returnflag"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.fixture
def skew_settings(spark):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.files.maxPartitionBytes": "200KB",
    }
    old = {k: spark.conf.get(k) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_a_best_seller_is_split_over_tasks(spark, skew_settings, final_plan):
    hot = spark.range(0, 60000, 1, 8).select(
        F.col("id").alias("ss_ticket_number"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("ss_item_sk"),
        F.col("id").alias("payload"),
    )
    items = spark.range(5000).select(
        F.col("id").alias("i_item_sk"), F.lit("n").alias("i_product_name"), F.lit("c").alias("i_category"),
        F.lit("k").alias("i_class"))
    enriched = S.enrich_transactions(hot, items)
    plan = final_plan(enriched)
    assert "SortMergeJoin(skew=true)" in plan
    assert enriched.count() == 60000


def test_label_counts_are_combined_before_the_shuffle(spark, small_dir, final_plan):
    rows = V.table(spark, small_dir, "lineitem").select("l_returnflag", "l_partkey", "l_tax")
    plan = final_plan(L.label_counts(rows, ["l_returnflag", "l_partkey"]))
    assert exchanges(plan) == 1 and "partial_count" in plan and "l_tax" not in plan


def test_calendar_is_one_projection(spark):
    df = spark.range(3).select(F.timestamp_seconds("id").alias("t"))
    made = add_calendar(df, {"t": ("hour", "dayofweek", "month", "quarter", "year", "weekofyear")})
    optimized = made._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Project") <= 2


def test_one_day_reads_one_partition(spark, small_dir, final_plan, tmp_path):
    from storeflow.operators.forecast import predictions_by_slot
    from storeflow.sources.tables import append_rows, ensure_schema, read_table

    ensure_schema(spark, "pruned", location=str(tmp_path / "pruned"))
    append_rows(V.predictions(spark, small_dir), "pruned", "predictions", partition_by=["date"])
    stored = read_table(spark, "pruned", "predictions")
    assert len(stored.inputFiles()) == stored.select("date").distinct().count()
    plan = final_plan(predictions_by_slot(stored, 3, "2024-01-20"))
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(prediction_slot,3)" in plan
    spark.sql("DROP SCHEMA pruned CASCADE")


def test_feed_is_a_top_k(spark, small_dir, final_plan):
    plan = final_plan(S.recent_feed(V.transactions(spark, small_dir)))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_comparison_is_one_aggregate_over_pruned_scans(spark, tmp_path, final_plan):
    from storeflow.operators.forecast import KEYS, forecast_vs_actual

    base = spark.range(5000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("date"),
        (F.col("id") % 12).cast("int").alias("prediction_slot"),
        (F.col("id") % 5).cast("string").alias("item_type"), (F.col("id") % 7).cast("string").alias("item_subtype"), F.lit(1).alias("q"))
    sides = []
    for name in ("predicted", "actual"):
        path = str(tmp_path / name)
        base.select(*KEYS, F.col("q").alias(f"{name}_quantity")).write.partitionBy("date").parquet(path)
        sides.append(spark.read.parquet(path))
    plan = final_plan(forecast_vs_actual(*sides))
    assert exchanges(plan) == 1 and "Join" not in plan
    for rows in (forecast_vs_actual(*sides, "2024-01-05"), forecast_vs_actual(*sides).filter("date = date'2024-01-05'")):
        plan = final_plan(rows)
        assert len(re.findall(r"PartitionFilters: \[[^\]]*date", plan)) == 2 and "Join" not in plan
