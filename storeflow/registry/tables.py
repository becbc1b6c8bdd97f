"""Sources and sinks: files and catalog tables written from the test tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storeflow.operators.forecast import KEYS, latest_predictions
from storeflow.registry import register
from storeflow.registry import views as V
from storeflow.session import fresh_path
from storeflow.sources import tables as S
from storeflow.sources import uploads as P


def new_schema(spark, prefix: str) -> str:
    """A schema of its own for one run, stored in the shared folder."""
    name = f"{prefix}_{uuid.uuid4().hex[:12]}"
    S.ensure_schema(spark, name, location=fresh_path(spark, name))
    return name


@register("csv_scan", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, ' s' || substring(store_id, 2) || ' ' AS store_id, sales_unit_qty,
       strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp,
       promo_quantity, lower(cat_id) AS cat_id, CAST("month" AS VARCHAR) AS "month"
FROM sales""")
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "sales-csv")
    V.sales(spark, sf_dir).write.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path, header=True)
    types = {
        "l_orderkey": "bigint", "l_linenumber": "int", "sales_unit_qty": "double",
        "promo_quantity": "double", "transaction_timestamp": "timestamp",
    }
    rows = S.read_sales_csv(spark, path, types)
    return V.tidy(rows.select(
        "l_orderkey", "l_linenumber", "store_id", "sales_unit_qty", "transaction_timestamp",
        "promo_quantity", "cat_id", "month"))


@register("csv_scan_headers", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def csv_scan_headers(spark, sf_dir):
    """Two feeds with other columns in another order."""
    orders = V.table(spark, sf_dir, "orders")
    first, second = fresh_path(spark, "orders-csv"), fresh_path(spark, "orders-csv")
    orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderpriority").write.csv(first, header=True)
    orders.filter("o_orderkey % 2 <> 0").select("o_custkey", "o_orderkey").write.csv(second, header=True)
    return S.read_sales_csv(spark, [first, second], {"o_orderkey": "bigint"})


@register("csv_mixed_headers", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey AS VARCHAR) END AS o_custkey,
       CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def csv_mixed_headers(spark, sf_dir):
    """One folder whose files have three headers."""
    orders, folder = V.table(spark, sf_dir, "orders"), fresh_path(spark, "orders-csv")
    headers = (
        ("o_orderkey", "o_custkey", "o_orderpriority"), ("o_custkey", "o_orderkey"),
        ("o_orderpriority", "o_orderstatus", "o_orderkey"),
    )
    for n, names in enumerate(headers):
        part = orders.filter(f"o_orderkey % 3 = {n}").select(*names).repartition(3)
        part.write.mode("append").csv(folder, header=True)
    return S.read_mixed_csv(spark, folder, {"o_orderkey": "bigint"}, "*.csv")


@register("table_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_scan(spark, sf_dir):
    schema = new_schema(spark, "scan")
    S.overwrite_table(V.table(spark, sf_dir, "orders"), schema, "orders")
    return S.read_table(spark, schema, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@register("list_tables", """SELECT 'customer' AS table_name, count(*) AS "rows" FROM customer
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def list_tables(spark, sf_dir):
    schema = new_schema(spark, "listed")
    for name in ("customer", "part", "supplier"):
        S.overwrite_table(V.table(spark, sf_dir, name), schema, name)
    return S.table_inventory(spark, schema)


@register("item_catalogue", """SELECT DISTINCT lower(p_type) AS category_id, p_type AS category,
       lower(p_brand) AS subtype_id, p_brand AS subtype FROM part""")
def item_catalogue(spark, sf_dir):
    pairs = V.table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    subtype = F.struct(F.lower("p_brand").alias("id"), F.col("p_brand").alias("name"))
    # Distinct pairs only: an array holds the subtypes of one category, not its items.
    catalogue = pairs.groupBy("p_type").agg(F.collect_list(subtype).alias("subtypes"))
    nested = catalogue.select(F.lower("p_type").alias("id"), F.col("p_type").alias("name"), "subtypes")
    return S.item_catalogue(nested)


@register("overwrite_table", """SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def overwrite_table(spark, sf_dir):
    schema = new_schema(spark, "written")
    customer = V.table(spark, sf_dir, "customer")
    # The first version has other columns: the second one replaces rows and schema.
    S.overwrite_table(customer.select("c_custkey", "c_name"), schema, "customer_by_nation")
    nation = V.table(spark, sf_dir, "nation")
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("n_name", "c_acctbal")
    S.overwrite_table(named, schema, "customer_by_nation")
    rows = S.read_table(spark, schema, "customer_by_nation")
    return V.tidy(
        rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")),
        {"balance": 2})


@register("ensure_schema", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def ensure_schema(spark, sf_dir):
    schema = new_schema(spark, "raw_data")
    S.ensure_schema(spark, schema)  # a second time: nothing happens
    S.overwrite_table(V.table(spark, sf_dir, "supplier"), schema, "supplier")
    S.ensure_schema(spark, schema)
    return S.read_table(spark, schema, "supplier").select("s_suppkey", "s_name", "s_nationkey")


COPIED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("catalog_copy", "\nUNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS "rows" FROM {name}""" for name in COPIED))
def catalog_copy(spark, sf_dir):
    source, target = new_schema(spark, "sample"), new_schema(spark, "raw_data")
    for name in COPIED:
        S.overwrite_table(V.table(spark, sf_dir, name), source, name)
    return S.copy_schema(spark, [source], [target])


ALL_TABLES = (*COPIED, "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register("catalog_copy_errors", "\nUNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS "rows", false AS failed FROM {name}""" for name in ALL_TABLES)
    + "\nUNION ALL SELECT 'broken', CAST(NULL AS BIGINT), true")
def catalog_copy_errors(spark, sf_dir):
    """Every test table, and one whose files cannot be read."""
    source, target = new_schema(spark, "sample"), new_schema(spark, "raw_data")
    for name in ALL_TABLES:
        spark.catalog.createTable(f"{source}.{name}", f"{sf_dir}/{name}.parquet", "parquet")
    broken = fresh_path(spark, "broken")
    V.table(spark, sf_dir, "region").write.csv(f"{broken}")
    spark.sql(f"CREATE TABLE {source}.broken (r_name STRING) USING parquet LOCATION '{broken}'")
    report = S.copy_report(spark, [source], [target])
    return report.select("table_name", "rows", F.col("error").isNotNull().alias("failed"))


@register("predictions_upload", f"""WITH {V.FORECAST_SQL},
uploads AS (
  SELECT * FROM predictions
  UNION ALL
  SELECT "date", prediction_slot, item_type, item_subtype, predicted_quantity + 10, 'm2',
         TIMESTAMP '2024-01-15 22:00:00' FROM predictions WHERE prediction_slot > 6),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "date", prediction_slot, item_type, item_subtype
                               ORDER BY uploaded_at DESC) AS n FROM uploads)
SELECT CAST("date" AS VARCHAR) AS "date", prediction_slot, item_type, item_subtype, predicted_quantity,
       model_version, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at FROM ranked WHERE n = 1""")
def predictions_upload(spark, sf_dir):
    schema = new_schema(spark, "forecast")
    first = V.predictions(spark, sf_dir)
    later = first.filter("prediction_slot > 6").select(
        *KEYS,
        (F.col("predicted_quantity") + 10).alias("predicted_quantity"),
        F.lit("m2").alias("model_version"),
        F.lit("2024-01-15 22:00:00").cast("timestamp").alias("uploaded_at"),
    )
    for batch in (first, later):
        S.append_rows(batch, schema, "predictions", partition_by=["date"])
    return V.tidy(latest_predictions(S.read_table(spark, schema, "predictions")).select(
        *KEYS, "predicted_quantity", "model_version", "uploaded_at"))


UPLOADS_SQL = f"""WITH {V.FORECAST_SQL},
uploads AS (
  SELECT * FROM predictions
  UNION ALL
  SELECT "date", prediction_slot, item_type, item_subtype, predicted_quantity + 10, 'm2',
         TIMESTAMP '2024-01-15 22:00:00' FROM predictions WHERE prediction_slot > 6
  UNION ALL
  SELECT "date", prediction_slot, item_type, item_subtype, predicted_quantity + 20, 'm0',
         TIMESTAMP '2024-01-15 21:00:00' FROM predictions WHERE day("date") % 2 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "date", prediction_slot, item_type, item_subtype
                               ORDER BY uploaded_at DESC) AS n FROM uploads)
SELECT CAST("date" AS VARCHAR) AS "date", prediction_slot, item_type, item_subtype, predicted_quantity,
       model_version, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at FROM ranked WHERE n = 1"""


def three_uploads(spark, sf_dir):
    """All predictions, newer ones for some slots, older ones for some dates; the second upload comes twice."""
    first, path = V.predictions(spark, sf_dir), fresh_path(spark, "uploads")

    def later(condition: str, more: int, version: str, time: str):
        return first.filter(condition).select(
            *KEYS, (F.col("predicted_quantity") + more).alias("predicted_quantity"), F.lit(version).alias("model_version"),
            F.lit(time).cast("timestamp").alias("uploaded_at"))

    newer = later("prediction_slot > 6", 10, "m2", "2024-01-15 22:00:00")
    older = later("day(date) % 2 = 0", 20, "m0", "2024-01-15 21:00:00")
    for name, rows in (("a", first), ("b", newer), ("c", older), ("b", newer)):
        P.upload(rows, path, name)
    return path


@register("predictions_latest", UPLOADS_SQL)
def predictions_latest(spark, sf_dir):
    return V.tidy(P.read_latest(spark, three_uploads(spark, sf_dir)))


@register("transactions_append_clear", f"""WITH {V.TRANSACTIONS_SQL}
SELECT ss_ticket_number, ss_item_sk, ss_store_sk, ss_quantity, CAST(ss_ext_sales_price AS DOUBLE) AS ss_ext_sales_price
FROM transactions WHERE ss_quantity > 25""")
def transactions_append_clear(spark, sf_dir):
    schema = new_schema(spark, "pos")
    rows = V.transactions(spark, sf_dir)
    S.append_rows(rows.filter("ss_quantity <= 25"), schema, "transactions")
    S.clear_table(spark, schema, "transactions")
    S.append_rows(rows.filter("ss_quantity > 25 and ss_quantity <= 40"), schema, "transactions")
    S.append_rows(rows.filter("ss_quantity > 40"), schema, "transactions")
    return V.tidy(S.read_table(spark, schema, "transactions").drop("ts"))
