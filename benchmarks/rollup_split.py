"""The roll-up as one aggregate, or as two that are joined, on a feed of 88 columns.

    python benchmarks/rollup_split.py <sf_dir> <work_dir> [rows per group]

First non-null values are structs, which makes the one aggregate sort its rows by
group. The split form sums and averages by hash and picks first values by sort,
both on the same key, and joins the two.
"""

from __future__ import annotations

import dataclasses
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.operators import hourly as H
from storeflow.operators.cleaning import col
from storeflow.registry import views as V
from storeflow.spec import SalesSpec

PICKED = 74
SPEC = dataclasses.replace(
    SalesSpec(), group_keys=("store_id", "item_id"), row_id="row_id", sum_columns=("sales_unit_qty", "Gross_sales", "promo_amount"),
    mean_columns=("avg_sell_price", "HOLD_TIME"),
)


def staged(spark: SparkSession, sf_dir: str, work: str, per_group: int) -> DataFrame:
    """Order lines with 74 further columns, half of them texts, a third of their values null."""
    path = f"{work}/wide-{per_group}"
    lines = V.table(spark, sf_dir, "lineitem")
    number = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(600_000 // per_group))
    made = []
    for i in range(PICKED):
        value = F.pmod(F.xxhash64("l_partkey", F.lit(i)), F.lit(1000))
        kind = value.cast("string") if i % 2 else value.cast("double")
        made.append(F.when(F.pmod(F.xxhash64("l_orderkey", F.lit(i)), F.lit(3)) > 0, kind).alias(f"c{i}"))
    rows = lines.select(
        F.monotonically_increasing_id().alias("row_id"), (number % 50).cast("string").alias("store_id"),
        number.cast("string").alias("item_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("transaction_timestamp"),
        F.col("l_returnflag").alias("promotion_id"), F.col("l_quantity").alias("promo_quantity"),
        F.col("l_quantity").alias("sales_unit_qty"), F.col("l_extendedprice").alias("Gross_sales"),
        F.col("l_discount").alias("promo_amount"), F.col("l_extendedprice").alias("avg_sell_price"), F.col("l_tax").alias("HOLD_TIME"), *made,
    )
    rows.repartition(16).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def split(rows: DataFrame, promotions: list[str]) -> DataFrame:
    keyed = H.keyed_rows(rows, SPEC)
    key = F.struct(*[col(k) for k in SPEC.group_keys], col(H.HOUR)).alias("key")  # nulls in it are equal
    special = {SPEC.time_column, SPEC.promotion, SPEC.row_id, H.HOUR, *SPEC.group_keys}
    summed = {n: F.sum(col(n)) for n in SPEC.sum_columns} | {n: F.avg(col(n)) for n in SPEC.mean_columns}
    picks = [H.first_non_null(n, SPEC).alias(n) for n in keyed.columns if n not in special and n not in summed]
    quantity = col(SPEC.promotion_quantity)
    sums = [
        F.coalesce(F.sum(F.when(col(SPEC.promotion) == p, quantity)), F.lit(0)).alias(H.promo_name(p)) for p in promotions
    ]
    left = keyed.groupBy(key).agg(*[c.alias(n) for n, c in summed.items()], *sums)
    return left.join(keyed.groupBy(key).agg(*picks), "key").select("key.*", "*").drop("key")


def main(sf_dir: str, work: str, per_group: int) -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "16").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows, promotions = staged(spark, sf_dir, work, per_group), ["A", "N", "R"]
    for name, make in (("one aggregate", lambda: H.hourly_sales(rows, SPEC, promotions)), ("two, joined", lambda: split(rows, promotions))):
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        print(name, per_group, "rows a group:", round(statistics.median(taken[1:]), 2), "s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 1)
