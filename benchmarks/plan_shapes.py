"""Two plan shapes for the same result, side by side on staged sales rows.

    python benchmarks/plan_shapes.py <sf_dir> <work_dir> [copies]

The first shape is the usual step-by-step one (pivot plus join, collected
statistics, StringIndexer, one withColumn per feature), the second is the one
the package uses. Rows are the test tables' order lines, repeated under other
store names.
"""

from __future__ import annotations

import math
import statistics
import sys
import time

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.functions.calendar import PERIODS
from storeflow.operators import hourly as H
from storeflow.operators import labels as L
from storeflow.operators import scaling as Z
from storeflow.operators.cleaning import add_hour, col, typed_rows
from storeflow.operators.features import add_calendar
from storeflow.registry import views as V

RUNS = 3
SCALED = ("Gross_sales", "avg_sell_price", "promo_amount", "promo_quantity", "HOLD_TIME", "MIN_PRES", "sales_unit_qty")
LABELLED = ("store_id", "Item Slin", "cat_id", "promotion_id", "event_name_1")
PARTS = ("hour", "dayofweek", "month", "quarter", "year", "weekofyear")


def staged(spark: SparkSession, sf_dir: str, work: str, copies: int) -> DataFrame:
    path = f"{work}/typed-sales-{copies}"
    rows = V.sales(spark, sf_dir).drop("l_orderkey", "l_linenumber")
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    named = repeated.withColumn("store_id", F.concat(F.trim("store_id"), F.lit("-"), F.col("copy") % 4)).drop("copy")
    typed_rows(named, V.SALES_SPEC).repartition(32).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rollup_by_join(rows: DataFrame) -> DataFrame:
    spec = V.SALES_SPEC
    keyed = add_hour(rows, spec.time_column, H.HOUR)
    keys = [*[col(k) for k in spec.group_keys], H.HOUR]
    wide = keyed.groupBy(*keys).pivot(spec.promotion).sum(spec.promotion_quantity).na.fill(0)
    picks = []
    for name in keyed.columns:
        if name in (*spec.group_keys, H.HOUR, spec.promotion, spec.time_column):
            continue
        how = F.sum if name in spec.sum_columns else F.avg if name in spec.mean_columns else None
        picks.append((how(col(name)) if how else F.first(col(name), ignorenulls=True)).alias(name))
    return keyed.groupBy(*keys).agg(*picks).join(wide, [*spec.group_keys, H.HOUR], "left")


def scale_by_collect(rows: DataFrame) -> DataFrame:
    stats = rows.agg(*[F.mean(c).alias(f"{c}_m") for c in SCALED], *[F.stddev(c).alias(f"{c}_s") for c in SCALED]).first()
    for name in SCALED:
        rows = rows.withColumn(name, (F.col(name) - stats[f"{name}_m"]) / stats[f"{name}_s"])
    return rows


def label_by_indexer(rows: DataFrame) -> DataFrame:
    made = [f"{c}_i" for c in LABELLED]
    rows = StringIndexer(inputCols=list(LABELLED), outputCols=made, handleInvalid="keep").fit(rows).transform(rows)
    for name, index in zip(LABELLED, made, strict=True):
        rows = rows.withColumn(name, F.col(index).cast("int")).drop(index)
    return rows


def calendar_step_by_step(rows: DataFrame) -> DataFrame:
    extract = {p: getattr(F, p) for p in PARTS}
    for part in PARTS:
        name = f"t_{part}"
        rows = rows.withColumn(name, extract[part]("transaction_timestamp"))
        if part in PERIODS:
            angle = F.col(name) * 2 * math.pi / PERIODS[part]
            rows = rows.withColumn(f"{name}_sin", F.sin(angle)).withColumn(f"{name}_cos", F.cos(angle)).drop(name)
    return rows


SHAPES = {
    "B1 roll-up with promotions": (rollup_by_join, lambda r: H.hourly_sales(r, V.SALES_SPEC)),
    "B1 promotions known": (rollup_by_join, lambda r: H.hourly_sales(r, V.SALES_SPEC, [None, "A", "R"])),
    "B2 scaling": (scale_by_collect, lambda r: Z.standard_scale(r, SCALED)),
    "B3 labels": (label_by_indexer, lambda r: L.label_encode(r, LABELLED)),
    "B4 calendar": (calendar_step_by_step, lambda r: add_calendar(r, {"transaction_timestamp": PARTS})),
}


def main(sf_dir: str, work: str, copies: int = 10) -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = staged(spark, sf_dir, work, copies)
    print("rows", rows.count())
    for name, shapes in SHAPES.items():
        timed = []
        for shape in shapes:
            runs = []
            for _ in range(RUNS + 1):
                start = time.perf_counter()
                shape(rows).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            timed.append(statistics.median(runs[1:]))
        print(f"{name}: step by step {timed[0]:.2f} s, package {timed[1]:.2f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *[int(a) for a in sys.argv[3:]])
