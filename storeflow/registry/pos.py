"""Point-of-sale lookups, totals and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from storeflow.operators import pos as S
from storeflow.registry import register
from storeflow.registry import views as V

ROW_SQL = "ss_ticket_number, ss_item_sk, ss_store_sk, ss_quantity"
ROW = ("ss_ticket_number", "ss_item_sk", "ss_store_sk", "ss_quantity")


def enriched(spark, sf_dir):
    rows = V.transactions(spark, sf_dir).select(*ROW)
    return S.enrich_transactions(rows, V.items(spark, sf_dir))


def priced(spark, sf_dir):
    prices = V.items(spark, sf_dir).select(
        F.col("i_item_sk").alias("ss_item_sk"), F.col("i_current_price").alias("ss_list_price"))
    return S.priced(V.transactions(spark, sf_dir).drop("ts").join(prices, "ss_item_sk", "left"))


ENRICHED_SQL = f"""{V.TRANSACTIONS_SQL}, {V.ITEMS_SQL},
enriched AS (
  SELECT {ROW_SQL}, i_product_name AS item_name, i_category AS item_category, i_class AS item_class
  FROM transactions LEFT JOIN items ON ss_item_sk = i_item_sk)"""

PRICED_SQL = f"""{V.TRANSACTIONS_SQL}, {V.ITEMS_SQL},
unit AS (
  SELECT {ROW_SQL}, ss_ext_sales_price,
         CAST(round(i_current_price * CAST(0.92 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS ss_sales_price
  FROM transactions LEFT JOIN items ON ss_item_sk = i_item_sk),
priced AS (
  SELECT {ROW_SQL}, ss_sales_price,
         CAST(coalesce(nullif(ss_ext_sales_price, 0), ss_quantity * ss_sales_price) AS DECIMAL(14,2)) AS total
  FROM unit)"""


@register("enrich_transactions", f"""WITH {ENRICHED_SQL}
SELECT * FROM enriched""")
def enrich_transactions(spark, sf_dir):
    return enriched(spark, sf_dir).select(*ROW, "item_name", "item_category", "item_class")


@register("store_lookup", f"""WITH {V.TRANSACTIONS_SQL}, {V.STORES_SQL}
SELECT {ROW_SQL}, s_store_name, s_city, s_state FROM transactions LEFT JOIN stores ON ss_store_sk = s_store_sk""")
def store_lookup(spark, sf_dir):
    rows = V.transactions(spark, sf_dir).select(*ROW)
    return S.store_lookup(rows, V.stores(spark, sf_dir)).select(*ROW, "s_store_name", "s_city", "s_state")


@register("ext_sales_price", f"""WITH {PRICED_SQL}
SELECT {ROW_SQL}, CAST(ss_sales_price AS DOUBLE) AS ss_sales_price, CAST(total AS DOUBLE) AS ss_ext_sales_price
FROM priced""")
def ext_sales_price(spark, sf_dir):
    return V.tidy(priced(spark, sf_dir).select(*ROW, "ss_sales_price", "ss_ext_sales_price"), {"ss_ext_sales_price": 2})


@register("pos_stats", f"""WITH {PRICED_SQL}
SELECT count(*) AS total_transactions, CAST(sum(ss_quantity) AS BIGINT) AS total_items_sold,
       round(CAST(sum(total) AS DOUBLE), 2) AS total_revenue FROM priced""")
def pos_stats(spark, sf_dir):
    return V.tidy(S.pos_stats(priced(spark, sf_dir)), {"total_revenue": 2})


@register("units_by_category", f"""WITH {ENRICHED_SQL}
SELECT item_category, CAST(sum(coalesce(ss_quantity, 0)) AS BIGINT) AS units
FROM enriched WHERE item_category IS NOT NULL GROUP BY item_category""")
def units_by_category(spark, sf_dir):
    return S.units_by_category(enriched(spark, sf_dir))


RANK_SQL = "CASE {c} " + " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(V.CATEGORIES, start=1)) + " END"
LISTED_SQL = ", ".join(f"'{c}'" for c in V.CATEGORIES)


@register("items_by_category", f"""WITH {V.ITEMS_SQL}
SELECT i_category, count(*) AS item_count, count(DISTINCT i_class) AS class_count,
       {RANK_SQL.format(c="i_category")} AS category_rank
FROM items WHERE i_category IN ({LISTED_SQL}) GROUP BY i_category""")
def items_by_category(spark, sf_dir):
    return S.items_by_category(V.items(spark, sf_dir), V.CATEGORIES)


@register("category_order", f"""WITH {V.ITEMS_SQL}
SELECT i_category, {RANK_SQL.format(c="i_category")} AS category_rank, i_item_sk, i_product_name, i_class,
       CAST(i_current_price AS DOUBLE) AS i_current_price
FROM items WHERE i_category IN ({LISTED_SQL})""")
def category_order(spark, sf_dir):
    return V.tidy(S.category_order(V.items(spark, sf_dir), V.CATEGORIES).select(
        "i_category", "category_rank", "i_item_sk", "i_product_name", "i_class", "i_current_price"))


@register("recent_feed", f"""WITH {V.TRANSACTIONS_SQL}
SELECT ss_ticket_number, ss_item_sk, ss_store_sk, ss_quantity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM transactions
ORDER BY transactions.ts DESC, ss_ticket_number DESC, ss_item_sk NULLS FIRST, ss_store_sk, ss_quantity LIMIT 50""")
def recent_feed(spark, sf_dir):
    return V.tidy(S.recent_feed(V.transactions(spark, sf_dir).select(*ROW, "ts")))
