"""The test tables seen as the feeds that the operators expect, in Spark and in SQL.

Each ``*_SQL`` text is a list of common table expressions for the SQL checks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeflow.operators.cleaning import col
from storeflow.spec import SalesSpec

PROMOTIONS = ("click", "error", "purchase", "signup", "view")
DAYS_AHEAD = 15

POS_SPEC = SalesSpec(
    group_keys=("store_id", "item_id"),
    row_id="event_id",
    categorical_columns=("store_id", "item_id", "promotion_id", "cat_id", "Holidays"),
    numeric_columns=("Gross_sales", "avg_sell_price", "promo_quantity"),
    flag_columns=("PERISHABLE",),
    fills={"Holidays": "No_Holiday", "promo_quantity": 0},
    drop_columns=("props",),
    scaled_columns=("Gross_sales", "avg_sell_price", "promo_quantity"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: Mapping[str, int] | None = None) -> DataFrame:
    """Comparable output: times as text, decimals as doubles, doubles rounded (6 digits)."""
    rounded = digits or {}

    def plain(f: T.StructField):
        c = col(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if isinstance(f.dataType, T.DecimalType):
            return F.round(c.cast("double"), rounded.get(f.name, 6))
        if isinstance(f.dataType, T.DoubleType):
            return F.round(c, rounded.get(f.name, 6))
        return c

    return df.select(*[plain(f).alias(f.name) for f in df.schema.fields])


# --- pos: one sale per event, with a time of day ----------------------------

def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("store_id"),
        (k % 3).cast("string").alias("item_id"),
        F.col("ts").cast("timestamp").alias("transaction_timestamp"),
        "event_id",
        F.col("event_type").alias("promotion_id"),
        F.col("value").alias("sales_unit_qty"),
        F.col("value").alias("Gross_sales"),
        F.col("value").alias("avg_sell_price"),
        F.when(k >= 20, F.col("value")).alias("promo_quantity"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("cat_id"),
        F.when(k < 5, F.col("event_type")).alias("Holidays"),
        F.when(k % 2 == 0, "y ").otherwise("N").alias("PERISHABLE"),
    )


POS_SQL = """
keyed AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
pos AS (
  SELECT 'S' || CAST(user_id % 4 AS VARCHAR) AS store_id, CAST(k % 3 AS VARCHAR) AS item_id,
         ts AS transaction_timestamp, event_id, event_type AS promotion_id, value AS sales_unit_qty,
         value AS "Gross_sales", value AS avg_sell_price,
         CASE WHEN k >= 20 THEN value END AS promo_quantity,
         nullif(event_type, 'error') AS cat_id,
         CASE WHEN k < 5 THEN event_type END AS "Holidays",
         CASE WHEN k % 2 = 0 THEN 'y ' ELSE 'N' END AS "PERISHABLE"
  FROM keyed)"""


# --- sales: raw text-like rows per order line, with gaps and bad values ------

SALES_SPEC = SalesSpec()


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    number, tax = F.col("l_linenumber"), F.col("l_tax")
    amount = F.col("l_extendedprice")
    bad_time = (number == 7) & (tax == 0.08)
    returned = (F.col("l_returnflag") == "R") & (number == 1)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit(" s"), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("store_id"),
        F.col("l_partkey").alias("Item Slin"),
        F.when(bad_time, "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("transaction_timestamp"),
        F.when(bad_time, "31/12/99").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day_date"),
        F.lower(F.nullif(F.col("l_returnflag"), F.lit("N"))).alias("promotion_id"),
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("sales_unit_qty"),
        F.when((number == 4) & (tax == 0.0), "n/a")
        .otherwise(F.when(returned, -amount).otherwise(amount).cast("string")).alias("Gross_sales"),
        F.when((number == 3) & (tax == 0.01), -1.0)
        .when(number != 2, amount / F.col("l_quantity")).alias("avg_sell_price"),
        F.when(F.col("l_discount") > 0.0, amount * F.col("l_discount")).alias("promo_amount"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).alias("promo_quantity"),
        F.nullif(tax, F.lit(0.02)).alias("HOLD_TIME"),
        F.nullif(F.col("l_discount"), F.lit(0.03)).alias("MIN_PRES"),
        F.when(number == 5, " fair").alias("event_name_1"),
        F.lower(F.nullif(F.col("l_linestatus"), F.lit("O"))).alias("cat_id"),
        F.when(F.col("l_linestatus") == "O", " y").otherwise("N").alias("PERISHABLE"),
        (tax > 0.04).cast("int").alias("snap_CA"),
        F.col("l_returnflag").alias("State"),
        F.month("l_shipdate").alias("month"),
    )


# The rows above after typing, which is where all SQL checks on them start.
SALES_SQL = """
sales AS (
  SELECT l_orderkey, l_linenumber, 'S' || CAST(l_suppkey AS VARCHAR) AS store_id,
         CAST(l_partkey AS VARCHAR) AS "Item Slin",
         CASE WHEN l_linenumber = 7 AND l_tax = 0.08 THEN NULL ELSE l_shipdate END AS transaction_timestamp,
         CASE WHEN l_linenumber = 7 AND l_tax = 0.08 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day_date,
         nullif(l_returnflag, 'N') AS promotion_id, nullif(l_quantity, 1.0) AS sales_unit_qty,
         CASE WHEN l_linenumber = 4 AND l_tax = 0.0 THEN NULL
              WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_extendedprice
              ELSE l_extendedprice END AS "Gross_sales",
         CASE WHEN l_linenumber = 3 AND l_tax = 0.01 THEN -1.0
              WHEN l_linenumber <> 2 THEN l_extendedprice / l_quantity END AS avg_sell_price,
         CASE WHEN l_discount > 0.0 THEN l_extendedprice * l_discount END AS promo_amount,
         CASE WHEN l_discount >= 0.05 THEN l_quantity END AS promo_quantity,
         nullif(l_tax, 0.02) AS "HOLD_TIME", nullif(l_discount, 0.03) AS "MIN_PRES",
         CASE WHEN l_linenumber = 5 THEN 'FAIR' END AS event_name_1,
         nullif(l_linestatus, 'O') AS cat_id,
         CASE WHEN l_linestatus = 'O' THEN ' y' ELSE 'N' END AS "PERISHABLE",
         CAST(l_tax > 0.04 AS INTEGER) AS "snap_CA", l_returnflag AS "State",
         CAST(month(l_shipdate) AS INTEGER) AS "month"
  FROM lineitem)"""


# --- retail: order lines with item and store attributes ----------------------

def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
    )
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("Item Slin"),
        F.col("p_brand").alias("ITEM_UNIT"),
        F.col("p_type").alias("cat_id"),
        F.nullif(F.col("n_name"), F.lit("NATION_3")).alias("County"),
        F.col("l_returnflag").alias("Flow"),
        F.col("l_quantity").alias("sales_unit_qty"),
        F.col("l_extendedprice").alias("Gross_sales"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("avg_sell_price"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("promo_amount"),
        F.lit(4.0).alias("HOLD_TIME"),
    )


RETAIL_SQL = """
retail AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS "Item Slin", p_brand AS "ITEM_UNIT", p_type AS cat_id,
         nullif(n_name, 'NATION_3') AS "County", l_returnflag AS "Flow", l_quantity AS sales_unit_qty,
         l_extendedprice AS "Gross_sales", l_extendedprice / l_quantity AS avg_sell_price,
         nullif(l_discount, 0.0) AS promo_amount, CAST(4.0 AS DOUBLE) AS "HOLD_TIME"
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey)"""


# --- items, stores, transactions --------------------------------------------

# Text order except for one type that is not listed, so that its items drop out.
CATEGORIES = ("SMALL", "ECONOMY", "STANDARD", "LARGE", "PROMO")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("i_item_sk"),
        F.col("p_name").alias("i_product_name"),
        F.col("p_type").alias("i_category"),
        F.col("p_brand").alias("i_class"),
        price.alias("i_current_price"),
    )


ITEMS_SQL = """
items AS (
  SELECT p_partkey AS i_item_sk, p_name AS i_product_name, p_type AS i_category, p_brand AS i_class,
         CAST(p_retailprice AS DECIMAL(12,2)) AS i_current_price FROM part)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(places, supplier.s_nationkey == places.n_nationkey).select(
        F.col("s_suppkey").alias("s_store_sk"),
        F.col("s_name").alias("s_store_name"),
        F.col("n_name").alias("s_city"),
        F.col("r_name").alias("s_state"),
    )


STORES_SQL = """
stores AS (
  SELECT s_suppkey AS s_store_sk, s_name AS s_store_name, n_name AS s_city, r_name AS s_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POS rows; some items are unknown and some line totals are missing or 0."""
    number = F.col("l_linenumber")
    recorded = F.when(number % 3 == 0, None).when(number % 3 == 1, 0.0).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ss_ticket_number"),
        F.when(number != 6, F.col("l_partkey")).alias("ss_item_sk"),
        F.col("l_suppkey").alias("ss_store_sk"),
        F.col("l_quantity").cast("int").alias("ss_quantity"),
        recorded.cast("decimal(14,2)").alias("ss_ext_sales_price"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


TRANSACTIONS_SQL = """
transactions AS (
  SELECT l_orderkey AS ss_ticket_number, CASE WHEN l_linenumber <> 6 THEN l_partkey END AS ss_item_sk,
         l_suppkey AS ss_store_sk, CAST(l_quantity AS INTEGER) AS ss_quantity,
         CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 0.0
              ELSE l_extendedprice END AS DECIMAL(14,2)) AS ss_ext_sales_price, l_shipdate AS ts
  FROM lineitem)"""


# --- predictions and actuals -------------------------------------------------

def slot_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POS rows as the forecast tables name them; cents as exact decimals."""
    return pos(spark, sf_dir).select(
        F.col("transaction_timestamp").alias("ts"),
        F.concat(F.lit("item-"), "item_id").alias("item_type"),
        F.col("promotion_id").alias("item_subtype"),
        F.col("sales_unit_qty").cast("decimal(18,2)").alias("quantity"),
    )


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole units of every day."""
    from storeflow.operators.forecast import KEYS, actuals_by_date

    units = F.round("actual_quantity").cast("int").alias("actual_quantity")
    return actuals_by_date(slot_sales(spark, sf_dir)).select(*KEYS, units)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same slot and item 15 days before, as a forecast."""
    from storeflow.operators.forecast import actuals_by_date

    return actuals_by_date(slot_sales(spark, sf_dir)).select(
        F.date_add("date", DAYS_AHEAD).alias("date"),
        "prediction_slot",
        "item_type",
        "item_subtype",
        F.round("actual_quantity").cast("int").alias("predicted_quantity"),
        F.lit("m1").alias("model_version"),
        F.lit("2024-01-15 20:00:00").cast("timestamp").alias("uploaded_at"),
    )


FORECAST_SQL = POS_SQL + """,
slot_sales AS (
  SELECT transaction_timestamp AS ts, CAST(transaction_timestamp AS DATE) AS "date",
         CAST(floor(hour(transaction_timestamp) / 2) AS INTEGER) + 1 AS prediction_slot,
         'item-' || item_id AS item_type, promotion_id AS item_subtype,
         CAST(sales_unit_qty AS DECIMAL(18,2)) AS quantity FROM pos),
slot_units AS (
  SELECT "date", prediction_slot, item_type, item_subtype, CAST(round(sum(quantity)) AS INTEGER) AS units
  FROM slot_sales GROUP BY ALL),
actuals AS (
  SELECT "date", prediction_slot, item_type, item_subtype, units AS actual_quantity
  FROM slot_units),
predictions AS (
  SELECT "date" + 15 AS "date", prediction_slot, item_type, item_subtype, units AS predicted_quantity,
         'm1' AS model_version, TIMESTAMP '2024-01-15 20:00:00' AS uploaded_at
  FROM slot_units)"""

COMPARISON_SQL = FORECAST_SQL + """,
joined AS (
  SELECT coalesce(p."date", a."date") AS "date", coalesce(p.prediction_slot, a.prediction_slot) AS prediction_slot,
         coalesce(p.item_type, a.item_type) AS item_type, coalesce(p.item_subtype, a.item_subtype) AS item_subtype,
         CAST(coalesce(predicted_quantity, 0) AS BIGINT) AS predicted_quantity,
         CAST(coalesce(actual_quantity, 0) AS BIGINT) AS actual_quantity
  FROM predictions p FULL OUTER JOIN actuals a
    ON p."date" = a."date" AND p.prediction_slot = a.prediction_slot
   AND p.item_type = a.item_type AND p.item_subtype = a.item_subtype),
scored AS (
  SELECT *, predicted_quantity - actual_quantity AS difference,
         CASE WHEN predicted_quantity = 0 AND actual_quantity = 0 THEN CAST(100.0 AS DOUBLE)
              WHEN actual_quantity = 0 THEN CAST(0.0 AS DOUBLE)
              ELSE greatest(CAST(0.0 AS DOUBLE), round(CAST(100.0 AS DOUBLE)
                   * (actual_quantity - abs(predicted_quantity - actual_quantity)) / actual_quantity, 1))
         END AS accuracy_pct
  FROM joined),
comparison AS (
  SELECT *, CASE WHEN accuracy_pct >= 85 THEN 'high' WHEN accuracy_pct >= 60 THEN 'medium' ELSE 'low' END
         AS accuracy_band FROM scored)"""
