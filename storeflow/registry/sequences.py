"""Time steps, model roles and training windows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from storeflow.operators import sequences as Q
from storeflow.operators.hourly import hourly_agg
from storeflow.registry import register
from storeflow.registry import views as V
from storeflow.registry.hourly import HOUR_TEXT, HOURS_SQL

KEYS = ("store_id", "item_id")
TIME, UNITS = "transaction_timestamp", "sales_unit_qty"


def hourly_units(spark, sf_dir):
    """Exact cents per store, item and hour."""
    rows = V.pos(spark, sf_dir).select(
        *KEYS, TIME, "event_id", F.col(UNITS).cast("decimal(18,2)").alias(UNITS))
    return hourly_agg(rows, V.POS_SPEC)


@register("time_index", f"""WITH {HOURS_SQL}
SELECT store_id, item_id, {HOUR_TEXT}, sales_unit_qty,
       CAST(date_diff('hour', min(hour_start) OVER (PARTITION BY store_id, item_id), hour_start) AS INTEGER) AS time_idx
FROM hourly""")
def time_index(spark, sf_dir):
    return V.tidy(Q.time_index(hourly_units(spark, sf_dir), KEYS, TIME))


@register("role_projection", f"""WITH {V.SALES_SQL}
SELECT l_orderkey, l_linenumber, store_id AS static_store, cat_id AS static_cat, "MIN_PRES" AS static_min_pres,
       event_name_1 AS known_event, "snap_CA" AS known_snap, sales_unit_qty AS unknown_units FROM sales""")
def role_projection(spark, sf_dir):
    from storeflow.operators.cleaning import typed_rows

    rows = typed_rows(V.sales(spark, sf_dir), V.SALES_SPEC)
    roles = Q.role_projection(rows, V.SALES_SPEC.roles, ("l_orderkey", "l_linenumber"))
    return roles.select(
        "l_orderkey", "l_linenumber",
        F.col("static_categoricals.store_id").alias("static_store"),
        F.col("static_categoricals.cat_id").alias("static_cat"),
        F.col("static_reals.MIN_PRES").alias("static_min_pres"),
        F.col("time_varying_known_categoricals.event_name_1").alias("known_event"),
        F.col("time_varying_known_reals.snap_CA").alias("known_snap"),
        F.col("time_varying_unknown_reals.sales_unit_qty").alias("unknown_units"),
    )


def _windows(source: str) -> str:
    def frame(lo: str, hi: str) -> str:
        return (f"list(CAST(units AS VARCHAR)) OVER (PARTITION BY store_id, item_id ORDER BY hour_start "
                f"ROWS BETWEEN {lo} AND {hi})")

    return f"""framed AS (
  SELECT store_id, item_id, hour_start, {frame("29 PRECEDING", "CURRENT ROW")} AS past,
         {frame("1 FOLLOWING", "7 FOLLOWING")} AS future FROM {source})
SELECT store_id, item_id, {HOUR_TEXT}, array_to_string(past, ',') AS history,
       array_to_string(future, ',') AS horizon FROM framed WHERE len(future) = 7"""


UNITS_SQL = f"""{V.POS_SQL},
units AS (
  SELECT store_id, item_id, date_trunc('hour', transaction_timestamp) AS hour_start,
         sum(CAST(sales_unit_qty AS DECIMAL(18,2))) AS units
  FROM pos GROUP BY ALL)"""


def _as_text(windows):
    def joined(name: str):
        return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)

    return V.tidy(windows.select(*KEYS, TIME, joined("history"), joined("horizon")))


@register("training_sequences", f"WITH {UNITS_SQL}, {_windows('units')}")
def training_sequences(spark, sf_dir):
    return _as_text(Q.training_sequences(hourly_units(spark, sf_dir), KEYS, TIME, UNITS))


@register("training_sequences_dense", f"""WITH {UNITS_SQL},
spans AS (SELECT store_id, item_id, min(hour_start) AS lo, max(hour_start) AS hi FROM units GROUP BY ALL),
grid AS (
  SELECT store_id, item_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_start FROM spans),
dense AS (
  SELECT store_id, item_id, hour_start, coalesce(units, CAST(0 AS DECIMAL(18,2))) AS units
  FROM grid LEFT JOIN units USING (store_id, item_id, hour_start)), {_windows('dense')}""")
def training_sequences_dense(spark, sf_dir):
    hourly = hourly_units(spark, sf_dir)
    return _as_text(Q.training_sequences(hourly, KEYS, TIME, UNITS, dense=True))


@register("training_sequences_pieces", f"WITH {UNITS_SQL}, {_windows('units')}")
def training_sequences_pieces(spark, sf_dir):
    """The same windows with every series cut into pieces of 50 steps."""
    return _as_text(Q.training_sequences(hourly_units(spark, sf_dir), KEYS, TIME, UNITS, piece=50))


def gappy_units(spark, sf_dir):
    """Hourly units without the hours after noon, and null from 6 to 8."""
    hour = F.hour(TIME)
    units = F.when(~hour.between(6, 8), F.col(UNITS)).alias(UNITS)
    return hourly_units(spark, sf_dir).where(hour <= 12).select(*KEYS, TIME, units)


NULLS_SQL = f"""WITH {UNITS_SQL},
gappy AS (
  SELECT store_id, item_id, hour_start, CASE WHEN hour(hour_start) NOT BETWEEN 6 AND 8 THEN units END AS units
  FROM units WHERE hour(hour_start) <= 12),
framed AS (
  SELECT store_id, item_id, hour_start,
         list(coalesce(CAST(units AS VARCHAR), '-')) OVER (PARTITION BY store_id, item_id ORDER BY hour_start
           ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS past,
         list(coalesce(CAST(units AS VARCHAR), '-')) OVER (PARTITION BY store_id, item_id ORDER BY hour_start
           ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS future FROM gappy)
SELECT store_id, item_id, {HOUR_TEXT}, array_to_string(past, ',') AS history,
       array_to_string(future, ',') AS horizon FROM framed WHERE len(future) = 7"""


def _with_nulls(windows):
    def joined(name: str):
        return F.array_join(F.transform(name, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias(name)

    return V.tidy(windows.select(*KEYS, TIME, joined("history"), joined("horizon")))


@register("training_sequences_nulls", NULLS_SQL)
def training_sequences_nulls(spark, sf_dir):
    return _with_nulls(Q.training_sequences(gappy_units(spark, sf_dir), KEYS, TIME, UNITS))


@register("training_sequences_nulls_pieces", NULLS_SQL)
def training_sequences_nulls_pieces(spark, sf_dir):
    return _with_nulls(Q.training_sequences(gappy_units(spark, sf_dir), KEYS, TIME, UNITS, piece=24))


@register("training_covariates", f"""WITH {UNITS_SQL},
steps AS (
  SELECT store_id, item_id, hour_start, CAST(units AS VARCHAR) || '|' || CAST(hour(hour_start) AS VARCHAR) || '|'
         || CAST(dayofmonth(hour_start) AS VARCHAR) AS step FROM units),
framed AS (
  SELECT store_id, item_id, hour_start,
         list(step) OVER (PARTITION BY store_id, item_id ORDER BY hour_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS past,
         list(step) OVER (PARTITION BY store_id, item_id ORDER BY hour_start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future
  FROM steps)
SELECT store_id, item_id, 'store ' || store_id AS store_name, {HOUR_TEXT}, array_to_string(past, ',') AS history,
       array_to_string(future, ',') AS horizon FROM framed WHERE len(future) = 3""")
def training_covariates(spark, sf_dir):
    hourly = hourly_units(spark, sf_dir).select(
        "*", F.hour(TIME).alias("hour"), F.dayofmonth(TIME).alias("day"),
        F.concat(F.lit("store "), "store_id").alias("store_name"))
    spec = dataclasses.replace(V.POS_SPEC, history=12, horizon=3, roles={
        "static_categoricals": ("store_name",), "time_varying_unknown_reals": (UNITS,),
        "time_varying_known_reals": ("hour", "day", "absent")})
    windows = Q.model_sequences(hourly, spec)

    def joined(name: str):
        step = lambda x: F.concat_ws("|", x[UNITS].cast("string"), x["hour"].cast("string"), x["day"].cast("string"))
        return F.array_join(F.transform(name, step), ",").alias(name)

    return V.tidy(windows.select(*KEYS, "store_name", TIME, joined("history"), joined("horizon")))
