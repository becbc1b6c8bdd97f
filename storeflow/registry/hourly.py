"""Roll-up to hours and the cleaning job as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from storeflow.operators import hourly as H
from storeflow.plans.cleaning import clean_hourly_sales
from storeflow.registry import register
from storeflow.registry import views as V

SPEC = V.POS_SPEC
KEYS = ("store_id", "item_id", "transaction_timestamp")

TOTALS = {"sales_unit_qty": 2, "Gross_sales": 2, **{H.promo_name(p): 2 for p in V.PROMOTIONS}}

HOURS_SQL = V.POS_SQL + """,
timed AS (SELECT *, date_trunc('hour', transaction_timestamp) AS hour_start FROM pos),
hourly AS (
  SELECT store_id, item_id, hour_start, round(sum(sales_unit_qty), 2) AS sales_unit_qty,
         round(sum("Gross_sales"), 2) AS "Gross_sales", avg(avg_sell_price) AS avg_sell_price,
         first(promo_quantity ORDER BY transaction_timestamp, event_id)
           FILTER (promo_quantity IS NOT NULL) AS promo_quantity,
         first(cat_id ORDER BY transaction_timestamp, event_id) FILTER (cat_id IS NOT NULL) AS cat_id,
         first("Holidays" ORDER BY transaction_timestamp, event_id) FILTER ("Holidays" IS NOT NULL) AS "Holidays",
         first("PERISHABLE" ORDER BY transaction_timestamp, event_id) AS "PERISHABLE"
  FROM timed GROUP BY store_id, item_id, hour_start),
promo AS (
  SELECT store_id, item_id, hour_start,
         """ + ",\n         ".join(
    f"round(coalesce(sum(promo_quantity) FILTER (promotion_id = '{p}'), 0), 2) AS feature_promo_{p}"
    for p in V.PROMOTIONS
) + """
  FROM timed GROUP BY store_id, item_id, hour_start)"""

HOUR_TEXT = "strftime(hour_start, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp"
PROMO_NAMES = ", ".join(f"feature_promo_{p}" for p in V.PROMOTIONS)


@register("hourly_agg", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, sales_unit_qty, "Gross_sales",
       round(avg_sell_price, 6) AS avg_sell_price, promo_quantity, cat_id,
       "Holidays", "PERISHABLE" FROM hourly""")
def hourly_agg(spark, sf_dir):
    return V.tidy(H.hourly_agg(V.pos(spark, sf_dir), SPEC), TOTALS)


@register("first_non_null", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, cat_id, "Holidays", promo_quantity FROM hourly""")
def first_non_null(spark, sf_dir):
    rows = H.keyed_rows(V.pos(spark, sf_dir), SPEC)
    picks = [H.first_non_null(n, SPEC).alias(n) for n in ("cat_id", "Holidays", "promo_quantity")]
    picked = rows.groupBy("store_id", "item_id", H.HOUR).agg(*picks)
    return V.tidy(H.restore_time_column(picked, "transaction_timestamp", H.HOUR))


@register("promo_pivot", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, {PROMO_NAMES} FROM promo""")
def promo_pivot(spark, sf_dir):
    rows = H.keyed_rows(V.pos(spark, sf_dir).select(*KEYS, "promotion_id", "promo_quantity"), SPEC)
    sums = rows.groupBy("store_id", "item_id", H.HOUR).agg(*H.promo_sums(SPEC, V.PROMOTIONS))
    return V.tidy(H.restore_time_column(sums, "transaction_timestamp", H.HOUR), TOTALS)


@register("fill_pivot_zero", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, {PROMO_NAMES} FROM promo""")
def fill_pivot_zero(spark, sf_dir):
    rows = V.pos(spark, sf_dir).select(*KEYS, "promotion_id", "promo_quantity")
    return V.tidy(H.promo_pivot(rows, SPEC, V.PROMOTIONS), TOTALS)


@register("prefix_pivot_columns", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, {", ".join(f'feature_promo_{p} AS "feature_promo_{p.upper()}"' for p in V.PROMOTIONS)}
FROM promo""")
def prefix_pivot_columns(spark, sf_dir):
    # The values are found in the data here; they are upper case after normalising.
    rows = V.pos(spark, sf_dir).select(*KEYS, F.upper("promotion_id").alias("promotion_id"), "promo_quantity")
    return V.tidy(H.promo_pivot(rows, SPEC), {H.promo_name(p.upper()): 2 for p in V.PROMOTIONS})


@register("promo_totals", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, promotion_id, {HOUR_TEXT}, round(coalesce(sum(promo_quantity), 0), 2) AS promo_quantity
FROM timed GROUP BY store_id, item_id, promotion_id, hour_start""")
def promo_totals(spark, sf_dir):
    return V.tidy(H.promo_totals(V.pos(spark, sf_dir), SPEC), {"promo_quantity": 2})


@register("promo_map", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, coalesce(promotion_id, 'null') AS promotion_id, {HOUR_TEXT},
       round(coalesce(sum(promo_quantity), 0), 2) AS promo_quantity
FROM timed GROUP BY store_id, item_id, promotion_id, hour_start""")
def promo_map(spark, sf_dir):
    hourly = H.hourly_sales(V.pos(spark, sf_dir), SPEC, form="map")
    return V.tidy(hourly.select(*KEYS, F.explode(H.PROMO_MAP).alias("promotion_id", "promo_quantity")), {"promo_quantity": 2})


@register("promo_unlisted", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, feature_promo_click,
       round({" + ".join(f"feature_promo_{p}" for p in V.PROMOTIONS if p != "click")}, 2) AS feature_promo_other
FROM promo""")
def promo_unlisted(spark, sf_dir):
    hourly = H.hourly_sales(V.pos(spark, sf_dir), SPEC, ["click"], unlisted="column")
    return V.tidy(hourly.select(*KEYS, "feature_promo_click", "feature_promo_other"),
                  {"feature_promo_click": 2, "feature_promo_other": 2})


def null_text(spark, sf_dir):
    """Promotions of which one is missing and one is the text null."""
    named = F.when(F.col("promotion_id") == "click", "null").when(F.col("promotion_id") != "view", F.col("promotion_id"))
    return V.pos(spark, sf_dir).withColumn("promotion_id", named)


NULL_TEXT_SQL = f"""{V.POS_SQL},
named AS (
  SELECT * EXCLUDE (promotion_id), date_trunc('hour', transaction_timestamp) AS hour_start,
         CASE promotion_id WHEN 'click' THEN 'null' WHEN 'view' THEN NULL ELSE promotion_id END AS promotion_id FROM pos)"""
NULL_TEXT = {None: "feature_promo_null", "null": "feature_promo_'null'", "error": "feature_promo_error"}


@register("promo_null_text_wide", f"""WITH {NULL_TEXT_SQL}
SELECT store_id, item_id, {HOUR_TEXT},
       round(coalesce(sum(promo_quantity) FILTER (promotion_id IS NULL), 0), 2) AS feature_promo_null,
       round(coalesce(sum(promo_quantity) FILTER (promotion_id = 'null'), 0), 2) AS "feature_promo_'null'",
       round(coalesce(sum(promo_quantity) FILTER (promotion_id = 'error'), 0), 2) AS feature_promo_error
FROM named GROUP BY store_id, item_id, hour_start""")
def promo_null_text_wide(spark, sf_dir):
    hourly = H.hourly_sales(null_text(spark, sf_dir), SPEC)
    return V.tidy(hourly.select(*KEYS, *[f"`{n}`" for n in NULL_TEXT.values()]), {n: 2 for n in NULL_TEXT.values()})


@register("promo_null_text_pivot", f"""WITH {NULL_TEXT_SQL}
SELECT store_id, item_id, {HOUR_TEXT},
       round(coalesce(sum(promo_quantity) FILTER (promotion_id IS NULL), 0), 2) AS feature_promo_null,
       round(coalesce(sum(promo_quantity) FILTER (promotion_id = 'null'), 0), 2) AS "feature_promo_'null'",
       round(coalesce(sum(promo_quantity) FILTER (promotion_id = 'error'), 0), 2) AS feature_promo_error
FROM named GROUP BY store_id, item_id, hour_start""")
def promo_null_text_pivot(spark, sf_dir):
    rows = null_text(spark, sf_dir).select(*KEYS, "promotion_id", "promo_quantity")
    wide = H.promo_pivot(rows, SPEC).select(*KEYS, *[f"`{n}`" for n in NULL_TEXT.values()])
    return V.tidy(wide, {n: 2 for n in NULL_TEXT.values()})


@register("promo_null_text_map", f"""WITH {NULL_TEXT_SQL}
SELECT store_id, item_id, CASE WHEN promotion_id IS NULL THEN 'null' WHEN promotion_id = 'null' THEN chr(39) || 'null' || chr(39) ELSE promotion_id END
         AS promotion_id, {HOUR_TEXT}, round(coalesce(sum(promo_quantity), 0), 2) AS promo_quantity
FROM named GROUP BY store_id, item_id, promotion_id, hour_start""")
def promo_null_text_map(spark, sf_dir):
    hourly = H.hourly_sales(null_text(spark, sf_dir), SPEC, form="map")
    return V.tidy(hourly.select(*KEYS, F.explode(H.PROMO_MAP).alias("promotion_id", "promo_quantity")), {"promo_quantity": 2})


@register("promo_null_text_rows", f"""WITH {NULL_TEXT_SQL}
SELECT store_id, item_id, promotion_id, {HOUR_TEXT}, round(coalesce(sum(promo_quantity), 0), 2) AS promo_quantity
FROM named GROUP BY store_id, item_id, promotion_id, hour_start""")
def promo_null_text_rows(spark, sf_dir):
    return V.tidy(H.promo_totals(null_text(spark, sf_dir), SPEC), {"promo_quantity": 2})


@register("promo_left_join", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, sales_unit_qty, cat_id, {PROMO_NAMES}
FROM hourly LEFT JOIN promo USING (store_id, item_id, hour_start)""")
def promo_left_join(spark, sf_dir):
    rows = V.pos(spark, sf_dir).drop("Gross_sales", "avg_sell_price", "Holidays", "PERISHABLE")
    return V.tidy(H.promo_left_join(rows, SPEC, V.PROMOTIONS).drop("promo_quantity"), TOTALS)


@register("clean_hourly_sales", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, sales_unit_qty, "Gross_sales", round(avg_sell_price, 6) AS avg_sell_price,
       coalesce(promo_quantity, 0) AS promo_quantity, coalesce(upper(cat_id), 'UNKNOWN') AS cat_id,
       coalesce(upper("Holidays"), 'No_Holiday') AS "Holidays", "PERISHABLE",
       {", ".join(f'feature_promo_{p} AS "feature_promo_{p.upper()}"' for p in V.PROMOTIONS)}
FROM hourly JOIN promo USING (store_id, item_id, hour_start)
WHERE sales_unit_qty >= 0 AND "Gross_sales" >= 0""")
def clean_pos(spark, sf_dir):
    upper = [p.upper() for p in V.PROMOTIONS]
    cleaned = clean_hourly_sales(V.pos(spark, sf_dir), SPEC, upper)
    return V.tidy(cleaned, {"sales_unit_qty": 2, "Gross_sales": 2, **{H.promo_name(p): 2 for p in upper}})


@register("clean_raw_sales", f"""WITH {V.SALES_SQL},
grouped AS (
  SELECT store_id, "Item Slin", transaction_timestamp AS t, min(day_date) AS day_date,
         sum(sales_unit_qty) AS sales_unit_qty, sum("Gross_sales") AS "Gross_sales",
         avg(avg_sell_price) AS avg_sell_price, sum(promo_amount) AS promo_amount,
         min(promo_quantity) AS first_promo, avg("HOLD_TIME") AS "HOLD_TIME", min("MIN_PRES") AS "MIN_PRES",
         min(event_name_1) AS event_name_1, min(cat_id) AS cat_id, min("PERISHABLE") AS "PERISHABLE",
         min("snap_CA") AS "snap_CA",
         coalesce(sum(promo_quantity) FILTER (promotion_id IS NULL), 0) AS p_null,
         coalesce(sum(promo_quantity) FILTER (promotion_id = 'A'), 0) AS p_a,
         coalesce(sum(promo_quantity) FILTER (promotion_id = 'R'), 0) AS p_r
  FROM sales GROUP BY store_id, "Item Slin", transaction_timestamp)
SELECT store_id, "Item Slin", strftime(t, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp,
       CAST(day_date AS VARCHAR) AS day_date, sales_unit_qty, round("Gross_sales", 2) AS "Gross_sales",
       round(avg_sell_price, 8) AS avg_sell_price, round(coalesce(promo_amount, 0), 4) AS promo_amount,
       coalesce(first_promo, 0) AS promo_quantity, round("HOLD_TIME", 6) AS "HOLD_TIME", "MIN_PRES",
       coalesce(event_name_1, 'No_Event') AS event_name_1, coalesce(cat_id, 'UNKNOWN') AS cat_id,
       "PERISHABLE", "snap_CA", CASE WHEN t IS NOT NULL THEN p_null END AS feature_promo_null,
       CASE WHEN t IS NOT NULL THEN p_a END AS "feature_promo_A",
       CASE WHEN t IS NOT NULL THEN p_r END AS "feature_promo_R"
FROM grouped WHERE sales_unit_qty >= 0 AND "Gross_sales" >= 0 AND (avg_sell_price >= 0 OR avg_sell_price IS NULL)""")
def clean_raw(spark, sf_dir):
    raw = V.sales(spark, sf_dir).drop("l_orderkey", "l_linenumber")
    cleaned = clean_hourly_sales(raw, V.SALES_SPEC, [None, "A", "R"])
    return V.tidy(cleaned, {"Gross_sales": 2, "promo_amount": 4, "avg_sell_price": 8})
