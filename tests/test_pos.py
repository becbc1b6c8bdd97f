import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storeflow.functions import pricing
from storeflow.operators import pos as S

ITEMS = "i_item_sk bigint, i_product_name string, i_category string, i_class string"
ROWS = "ss_ticket_number bigint, ss_item_sk bigint, ss_quantity int"


@pytest.mark.parametrize("text, quantity", [
    ("", None), ("0", None), ("-5", 5), ("2.5", 25), ("abc", None), (None, None), ("0012", 12), ("99999999999", None),
])
def test_typed_quantities(spark, text, quantity):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(pricing.valid_quantity(F.col("q"))).first()[0] == quantity


@pytest.mark.parametrize("listed, price", [("31.87", "29.32"), ("249.99", "229.99"), ("0.05", "0.05"), (None, None)])
def test_sales_price_in_cents(spark, listed, price):
    df = spark.createDataFrame([(listed and Decimal(listed),)], "p decimal(12,2)")
    got = df.select(pricing.sales_price(F.col("p"))).first()[0]
    assert got == (price and Decimal(price))


@pytest.mark.parametrize("recorded, total", [(None, "6.00"), ("0.00", "6.00"), ("5.50", "5.50")])
def test_line_total(spark, recorded, total):
    df = spark.createDataFrame([(recorded and Decimal(recorded), 3, Decimal("2.00"))],
                               "e decimal(14,2), q int, p decimal(12,2)")
    assert df.select(pricing.ext_sales_price(F.col("e"), F.col("q"), F.col("p"))).first()[0] == Decimal(total)


def test_units_skip_unknown_categories(spark):
    items = spark.createDataFrame([(1, "bun", "bread", "soft"), (2, "tea", None, "hot")], ITEMS)
    rows = spark.createDataFrame([(1, 1, 2), (2, 1, None), (3, 2, 9), (4, 7, 9), (5, None, 1)], ROWS)
    enriched = S.enrich_transactions(rows, items)
    assert enriched.count() == 5 and enriched.filter("item_name is null").count() == 2
    assert [tuple(r) for r in S.units_by_category(enriched).collect()] == [("bread", 2)]


def test_empty_stats_are_zero(spark):
    df = spark.createDataFrame([], "ss_quantity int, ss_ext_sales_price decimal(14,2)")
    assert tuple(S.pos_stats(df).first()) == (0, 0, Decimal("0.00"))


def test_categories_follow_the_list(spark):
    items = spark.createDataFrame(
        [(1, "a", "tea", "hot"), (2, "b", "bread", "soft"), (3, "c", "bread", "soft"), (4, "d", "bread", None),
         (5, "e", "toys", "x")], ITEMS)
    order = ("tea", "cake", "bread")
    assert [tuple(r) for r in S.items_by_category(items, order).collect()] == [("tea", 1, 1, 1), ("bread", 3, 1, 3)]
    assert [r.i_item_sk for r in S.category_order(items, order).collect()] == [1, 2, 3, 4]


def test_feed_is_newest_first(spark):
    rows = [(n, 1, 1, dt.datetime(2024, 1, 1, n % 3)) for n in range(6)]
    df = spark.createDataFrame(rows, ROWS + ", ts timestamp")
    assert [r.ss_ticket_number for r in S.recent_feed(df, 3).collect()] == [5, 2, 4]
