"""Row-wise cleaning steps, null rules, calendar parts and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from storeflow.functions import accuracy, calendar, pricing
from storeflow.functions.slots import slot_of
from storeflow.functions.text import upper_trim
from storeflow.operators import cleaning as K
from storeflow.operators.features import add_calendar, binary_flags
from storeflow.operators.scaling import log1p_target
from storeflow.registry import register
from storeflow.registry import views as V
from storeflow.spec import SalesSpec

SPEC = V.SALES_SPEC
LINE = ("l_orderkey", "l_linenumber")


@register("drop_configured", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, ' s' || substring(store_id, 2) || ' ' AS store_id, "PERISHABLE", "snap_CA"
FROM sales""")
def drop_configured(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(*LINE, "store_id", "PERISHABLE", "snap_CA", "State", "month")
    return K.drop_configured(rows, SPEC.drop_columns)


@register("normalise_categoricals", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, store_id, "Item Slin", promotion_id, event_name_1, cat_id FROM sales""")
def normalise_categoricals(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(
        *LINE, "store_id", "Item Slin", "promotion_id", "event_name_1", "cat_id")
    return K.normalise_categoricals(rows, SPEC.categorical_columns)


@register("upper_trim", "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment FROM customer")
def upper_trim_query(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return V.table(spark, sf_dir, "customer").select("c_custkey", upper_trim(padded).alias("segment"))


@register("parse_timestamps", f"""WITH {V.POS_SQL}
SELECT event_id, CASE WHEN promotion_id = 'error' THEN NULL
       ELSE strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') END AS transaction_timestamp FROM pos""")
def parse_timestamps(spark, sf_dir):
    text = F.when(F.col("promotion_id") == "error", "not a time").otherwise(
        F.col("transaction_timestamp").cast("string"))
    rows = V.pos(spark, sf_dir).select("event_id", text.alias("transaction_timestamp"))
    return V.tidy(K.parse_timestamps(rows, ["transaction_timestamp"]))


@register("parse_dates", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, CAST(day_date AS VARCHAR) AS day_date FROM sales""")
def parse_dates(spark, sf_dir):
    return V.tidy(K.parse_dates(V.sales(spark, sf_dir).select(*LINE, "day_date"), SPEC.date_columns))


@register("cast_numerics", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, "Gross_sales", round(avg_sell_price, 8) AS avg_sell_price, "MIN_PRES" FROM sales""")
def cast_numerics(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(*LINE, "Gross_sales", "avg_sell_price", "MIN_PRES")
    return V.tidy(K.cast_numerics(rows, SPEC.numeric_columns), {"avg_sell_price": 8})


@register("hour_bucket", f"""WITH {V.POS_SQL}
SELECT event_id, strftime(date_trunc('hour', transaction_timestamp), '%Y-%m-%d %H:%M:%S') AS hour_start FROM pos""")
def hour_bucket(spark, sf_dir):
    rows = V.pos(spark, sf_dir).select("event_id", "transaction_timestamp")
    return V.tidy(K.add_hour(rows, "transaction_timestamp", "hour_start").drop("transaction_timestamp"))


@register("restore_time_column", f"""WITH {V.POS_SQL}
SELECT event_id, strftime(date_trunc('hour', transaction_timestamp), '%Y-%m-%d %H:%M:%S')
       AS transaction_timestamp FROM pos""")
def restore_time_column(spark, sf_dir):
    rows = V.pos(spark, sf_dir).select("event_id", "transaction_timestamp")
    hours = K.add_hour(rows, "transaction_timestamp", "hour_start")
    return V.tidy(K.restore_time_column(hours, "transaction_timestamp", "hour_start"))


def _sales_values() -> str:
    present = {
        "transaction_timestamp": ("timestamp", "transaction_timestamp", "l_shipdate"),
        "day_date": ("date", "day_date", "l_shipdate"),
        "Gross_sales": ("numeric", '"Gross_sales"', "l_extendedprice"),
    }
    parts = [
        f"""SELECT '{name}' AS "column", '{step}' AS expected_by, true AS present, """
        f"""count(*) FILTER ({typed} IS NULL) AS rejected FROM sales"""
        for name, (step, typed, _) in present.items()
    ]
    return "\nUNION ALL ".join(parts)


@register("column_report", f"""WITH {V.SALES_SQL}
{_sales_values()}
UNION ALL SELECT 'MAX_PRES', 'numeric', false, 0
UNION ALL SELECT 'State', 'drop', true, 0
UNION ALL SELECT 'wm_yr_wk', 'drop', false, 0
UNION ALL SELECT 'store_id', 'group_key', true, 0
UNION ALL SELECT 'snap_TX', 'flag', false, 0
UNION ALL SELECT 'PERISHABLE', 'flag', true, 0
UNION ALL SELECT 'sales_unit_qty', 'gate', true, 0
UNION ALL SELECT 'Gross_sales', 'gate', true, 0
UNION ALL SELECT 'avg_sell_price', 'gate', true, 0
UNION ALL SELECT 'sales_unit_qty', 'scale', true, 0""")
def column_report(spark, sf_dir):
    spec = V.SalesSpec(
        numeric_columns=("Gross_sales", "MAX_PRES"), drop_columns=("State", "wm_yr_wk"),
        categorical_columns=(), group_keys=("store_id",), fills={}, calendar={},
        flag_columns=("snap_TX", "PERISHABLE"), scaled_columns=(),
    )
    return K.column_report(V.sales(spark, sf_dir), spec)


def _gate(name: str, column: str, where: str, keep_null: bool = False):
    quoted = f'"{column}"'

    @register(name, f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, round({quoted}, 8) AS {quoted} FROM sales WHERE {where}""")
    def gate(spark, sf_dir):
        rows = K.cast_numerics(V.sales(spark, sf_dir).select(*LINE, column), SPEC.numeric_columns)
        return V.tidy(K.gate_not_negative(rows, column, keep_null), {column: 8})


_gate("gate_target", "sales_unit_qty", "sales_unit_qty >= 0")
_gate("gate_gross", "Gross_sales", '"Gross_sales" >= 0')
_gate("gate_price", "avg_sell_price", "avg_sell_price >= 0 OR avg_sell_price IS NULL", keep_null=True)


@register("fill_configured", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, coalesce(event_name_1, 'No_Event') AS event_name_1,
       coalesce(promo_quantity, 0) AS promo_quantity, round(coalesce(promo_amount, 0), 4) AS promo_amount, cat_id
FROM sales""")
def fill_configured(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(*LINE, "event_name_1", "promo_quantity", "promo_amount", "cat_id")
    typed = K.normalise_categoricals(rows, SPEC.categorical_columns)
    return V.tidy(K.fill_configured(typed, SPEC.fills), {"promo_amount": 4})


@register("fill_unknown", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, event_name_1, coalesce(cat_id, 'UNKNOWN') AS cat_id,
       coalesce(promotion_id, 'UNKNOWN') AS promotion_id FROM sales""")
def fill_unknown(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(*LINE, "event_name_1", "cat_id", "promotion_id")
    typed = K.normalise_categoricals(rows, SPEC.categorical_columns)
    return K.fill_unknown(typed, SPEC.categorical_columns, own_rule=SPEC.fills)


@register("valid_quantity", r"""WITH typed AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '0'
         WHEN 3 THEN '-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
         WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5' WHEN 5 THEN 'abc'
         ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS typed FROM lineitem),
read AS (SELECT *, TRY_CAST(regexp_replace(typed, '[^0-9]', '', 'g') AS INTEGER) AS quantity FROM typed)
SELECT l_orderkey, l_linenumber, typed, quantity FROM read WHERE quantity > 0""")
def valid_quantity(spark, sf_dir):
    number, units = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    typed = (
        F.when(number == 1, "").when(number == 2, "0").when(number == 3, F.concat(F.lit("-"), units))
        .when(number == 4, F.concat(units, F.lit(".5"))).when(number == 5, "abc").otherwise(units)
    )
    rows = V.table(spark, sf_dir, "lineitem").select(*LINE, typed.alias("typed"))
    read = rows.withColumn("quantity", pricing.valid_quantity(F.col("typed")))
    return read.filter(F.col("quantity").isNotNull())


CALENDAR_SQL = {
    "hour": "hour(t)", "dayofweek": "dayofweek(t) + 1", "dayofmonth": "day(t)", "month": "month(t)",
    "quarter": "quarter(t)", "year": "year(t)", "weekofyear": "week(t)",
    "is_weekend": "CASE WHEN dayofweek(t) IN (0, 6) THEN 1 ELSE 0 END",
}


def _calendar(part: str, expression: str):
    @register(f"cal_{part}", f"""WITH {V.POS_SQL}, timed AS (SELECT event_id, transaction_timestamp AS t FROM pos)
SELECT event_id, CAST({expression} AS INTEGER) AS {part} FROM timed""")
    def query(spark, sf_dir):
        moment = F.col("transaction_timestamp")
        return V.pos(spark, sf_dir).select("event_id", calendar.PARTS[part](moment).alias(part))


for _part, _expression in CALENDAR_SQL.items():
    _calendar(_part, _expression)


def _cycles() -> str:
    made = []
    for part, period in calendar.PERIODS.items():
        for function in ("sin", "cos"):
            angle = f"2 * pi() * ({CALENDAR_SQL[part]}) / {period}"
            made.append(f"round({function}({angle}), 6) + 0.0 AS transaction_timestamp_{part}_{function}")
    return ",\n       ".join(made)


@register("cyclical_encode", f"""WITH {V.POS_SQL}, timed AS (SELECT event_id, transaction_timestamp AS t FROM pos)
SELECT event_id, {_cycles()} FROM timed""")
def cyclical_encode(spark, sf_dir):
    rows = V.pos(spark, sf_dir).select("event_id", "transaction_timestamp")
    encoded = add_calendar(rows, {"transaction_timestamp": tuple(calendar.PERIODS)})
    return V.tidy(encoded.drop("transaction_timestamp"))


@register("binary_flags", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, CAST(upper(trim("PERISHABLE")) = 'Y' AS INTEGER) AS "PERISHABLE",
       CAST(0 AS INTEGER) AS "snap_CA" FROM sales""")
def flags_strict(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(*LINE, "PERISHABLE", "snap_CA")
    return binary_flags(rows, SPEC.flag_columns, SPEC.truthy)


@register("binary_flags_digits", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, CAST(upper(trim("PERISHABLE")) = 'Y' AS INTEGER) AS "PERISHABLE", "snap_CA"
FROM sales""")
def flags_digits(spark, sf_dir):
    rows = V.sales(spark, sf_dir).select(*LINE, "PERISHABLE", "snap_CA")
    return binary_flags(rows, SPEC.flag_columns, ("Y", "1"))


def _mapped(name: str, hit: int, miss: int) -> None:
    """The flag map in either order of its values."""
    @register(name, f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, CASE WHEN upper(trim("PERISHABLE")) = 'N' THEN {hit} ELSE {miss} END AS "PERISHABLE"
FROM sales""")
    def query(spark, sf_dir):
        config = {"Features": {"categorical_encoding": {"binary_encoding": {
            "columns": ["PERISHABLE"], "map": {"N": hit, "Y": miss}}}}}
        spec = SalesSpec.from_config(config)
        rows = V.sales(spark, sf_dir).select(*LINE, "PERISHABLE")
        return binary_flags(rows, spec.flag_columns, spec.truthy, spec.flag_values)


_mapped("binary_flags_map_no", 0, 1)
_mapped("binary_flags_map_yes", 1, 0)


@register("log1p_target", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, round(ln(1 + sales_unit_qty), 6) AS sales_unit_qty FROM sales""")
def log1p(spark, sf_dir):
    return V.tidy(log1p_target(V.sales(spark, sf_dir).select(*LINE, "sales_unit_qty"), "sales_unit_qty"))


@register("slot_of", f"""WITH {V.POS_SQL}
SELECT event_id, CAST(floor(hour(transaction_timestamp) / 2) AS INTEGER) + 1 AS slot FROM pos""")
def slot_of_query(spark, sf_dir):
    return V.pos(spark, sf_dir).select("event_id", slot_of(F.col("transaction_timestamp")).alias("slot"))


@register("sales_price", f"""WITH {V.ITEMS_SQL}
SELECT i_item_sk, CAST(round(i_current_price * CAST(0.92 AS DECIMAL(3,2)), 2) AS DOUBLE) AS ss_sales_price FROM items""")
def sales_price(spark, sf_dir):
    price = pricing.sales_price(F.col("i_current_price")).alias("ss_sales_price")
    return V.tidy(V.items(spark, sf_dir).select("i_item_sk", price))


def _score(name: str, result: str, expression):
    @register(name, f"""WITH {V.COMPARISON_SQL}
SELECT CAST("date" AS VARCHAR) AS "date", prediction_slot, item_type, item_subtype, {result} FROM comparison""")
    def query(spark, sf_dir):
        from storeflow.operators.forecast import KEYS, forecast_vs_actual

        both = forecast_vs_actual(V.predictions(spark, sf_dir), V.actuals(spark, sf_dir))
        return V.tidy(both.select(*KEYS, expression().alias(result)))


def _accuracy():
    return accuracy.accuracy_pct(F.col("predicted_quantity"), F.col("actual_quantity"))


_score("difference", "difference",
       lambda: accuracy.difference(F.col("predicted_quantity"), F.col("actual_quantity")))
_score("accuracy_pct", "accuracy_pct", _accuracy)
_score("accuracy_band", "accuracy_band", lambda: accuracy.accuracy_band(_accuracy()))
