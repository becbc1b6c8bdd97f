"""Point-of-sale rows: lookups, totals and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeflow.functions.literals import literal_rows
from storeflow.functions.pricing import ext_sales_price, sales_price

FEED_SIZE = 50


def enrich_transactions(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """Add name, category and class of the item, by its surrogate key.

    The item table grows with the business, so no broadcast is forced: below
    the session's threshold Catalyst chooses one, above it the join shuffles
    and adaptive execution splits the rows of a best-seller.
    """
    looked_up = items.select(
        F.col("i_item_sk").alias("ss_item_sk"),
        F.col("i_product_name").alias("item_name"),
        F.col("i_category").alias("item_category"),
        F.col("i_class").alias("item_class"),
    )
    return transactions.join(looked_up, "ss_item_sk", "left")


def store_lookup(transactions: DataFrame, stores: DataFrame) -> DataFrame:
    """Add store name, city and state, by surrogate key: the business id repeats."""
    looked_up = stores.select(
        F.col("s_store_sk").alias("ss_store_sk"), "s_store_name", "s_city", "s_state"
    )
    return transactions.join(looked_up, "ss_store_sk", "left")


def priced(transactions: DataFrame) -> DataFrame:
    """Add the unit price and complete the line total."""
    with_price = transactions.withColumn("ss_sales_price", sales_price(F.col("ss_list_price")))
    total = ext_sales_price(F.col("ss_ext_sales_price"), F.col("ss_quantity"), F.col("ss_sales_price"))
    return with_price.withColumn("ss_ext_sales_price", total)


def pos_stats(transactions: DataFrame) -> DataFrame:
    """Number of transactions, units and revenue."""
    return transactions.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum("ss_quantity"), F.lit(0)).alias("total_items_sold"),
        F.round(F.coalesce(F.sum("ss_ext_sales_price"), F.lit(0)), 2).alias("total_revenue"),
    )


def units_by_category(enriched: DataFrame) -> DataFrame:
    """Units per category; rows without a category are left out."""
    known = enriched.filter(F.col("item_category").isNotNull())
    units = F.sum(F.coalesce(F.col("ss_quantity"), F.lit(0)))
    return known.groupBy("item_category").agg(units.alias("units"))


def _ranks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    ranks = [(name, rank) for rank, name in enumerate(order, start=1)]
    return literal_rows(df.sparkSession, ("i_category", "category_rank"), ranks)


def category_order(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Items of the listed categories in list order; others are left out.

    Items stay rows: a category may hold a third of them. The sort is by range
    on rank and item, so such a category is spread over many tasks.
    """
    ranks = F.broadcast(_ranks(items, order))  # as many rows as the caller listed
    return items.join(ranks, "i_category").orderBy("category_rank", "i_item_sk")


def items_by_category(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per listed category: number of items and of distinct classes, in list order."""
    # Equal (category, class) pairs collapse first, so the second step sees few rows.
    pairs = items.groupBy("i_category", "i_class").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.groupBy("i_category").agg(
        F.sum("n").alias("item_count"), F.count("i_class").alias("class_count")
    )
    ranks = F.broadcast(_ranks(items, order))
    return counted.join(ranks, "i_category").orderBy("category_rank")


def recent_feed(transactions: DataFrame, size: int = FEED_SIZE) -> DataFrame:
    """The newest transactions; a top-k per task, then one merge of those."""
    rest = [c for c in transactions.columns if c not in ("ts", "ss_ticket_number")]
    return transactions.orderBy(
        F.col("ts").desc(), F.col("ss_ticket_number").desc(), *[F.col(c) for c in rest]
    ).limit(size)
