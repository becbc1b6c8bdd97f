"""Predictions by day, slot and category, and their comparison with actual sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from storeflow.functions.slots import SLOT_LABELS
from storeflow.operators import forecast as P
from storeflow.registry import register
from storeflow.registry import views as V

DAY, SLOT, CATEGORY = "2024-01-20", 6, "item-1"

KEYS_SQL = 'CAST("date" AS VARCHAR) AS "date", prediction_slot, item_type, item_subtype'
PREDICTED_SQL = f"SELECT {KEYS_SQL}, predicted_quantity FROM predictions"


def _chosen(name: str, where: str, choose):
    @register(name, f"""WITH {V.FORECAST_SQL}
{PREDICTED_SQL} WHERE "date" = DATE '{DAY}'{where}""")
    def query(spark, sf_dir):
        return V.tidy(choose(V.predictions(spark, sf_dir)).select(*P.KEYS, "predicted_quantity"))


_chosen("predictions_by_date", "", lambda p: P.predictions_by_date(p, DAY))
_chosen("predictions_by_slot", f" AND prediction_slot = {SLOT}", lambda p: P.predictions_by_slot(p, SLOT, DAY))
_chosen("predictions_by_category", f" AND item_type = '{CATEGORY}'",
        lambda p: P.predictions_by_category(p, CATEGORY, DAY))


def comparison(spark, sf_dir):
    return P.compare(V.predictions(spark, sf_dir), V.actuals(spark, sf_dir))


@register("actuals_by_date", f"""WITH {V.FORECAST_SQL}
SELECT {KEYS_SQL}, CAST(sum(quantity) AS DOUBLE) AS actual_quantity FROM slot_sales GROUP BY ALL""")
def actuals_by_date(spark, sf_dir):
    return V.tidy(P.actuals_by_date(V.slot_sales(spark, sf_dir)))


@register("forecast_vs_actual", f"""WITH {V.COMPARISON_SQL}
SELECT {KEYS_SQL}, predicted_quantity, actual_quantity FROM comparison""")
def forecast_vs_actual(spark, sf_dir):
    return V.tidy(P.forecast_vs_actual(V.predictions(spark, sf_dir), V.actuals(spark, sf_dir)))


LABEL_SQL = "CASE prediction_slot " + " ".join(
    f"WHEN {n} THEN '{label}'" for n, label in enumerate(SLOT_LABELS, start=1)
) + " ELSE 'Slot ' || CAST(prediction_slot AS VARCHAR) END AS slot_label"


@register("slot_lookup", f"""WITH {V.FORECAST_SQL},
shifted AS (SELECT prediction_slot + 2 AS prediction_slot, item_type, item_subtype, predicted_quantity FROM predictions)
SELECT prediction_slot, item_type, item_subtype, predicted_quantity, {LABEL_SQL} FROM shifted""")
def slot_lookup(spark, sf_dir):
    # Two slots later: the last two do not exist and show their fallback.
    shifted = V.predictions(spark, sf_dir).select(
        (F.col("prediction_slot") + 2).alias("prediction_slot"), "item_type", "item_subtype", "predicted_quantity")
    return P.slot_label(shifted)


@register("comparison_by_category", f"""WITH {V.COMPARISON_SQL}
SELECT {KEYS_SQL}, predicted_quantity, actual_quantity, difference, accuracy_pct, accuracy_band
FROM comparison WHERE item_type = '{CATEGORY}'""")
def comparison_by_category(spark, sf_dir):
    return V.tidy(P.comparison_by_category(comparison(spark, sf_dir), CATEGORY))


MEASURES_SQL = """round(avg(coalesce(accuracy_pct, 0)), 1) AS avg_accuracy,
       CAST(sum(predicted_quantity) AS BIGINT) AS total_predicted, CAST(sum(actual_quantity) AS BIGINT) AS total_actual,
       count(*) FILTER (difference > 0) AS over_predicted, count(*) FILTER (difference < 0) AS under_predicted,
       count(*) FILTER (difference = 0) AS exact, count(*) AS total"""


@register("comparison_summary", f"""WITH {V.COMPARISON_SQL}
SELECT {MEASURES_SQL} FROM comparison HAVING count(*) > 0""")
def comparison_summary(spark, sf_dir):
    return P.comparison_summary(comparison(spark, sf_dir))


@register("monthly_comparison", f"""WITH {V.COMPARISON_SQL}
SELECT CAST(CAST(date_trunc('month', "date") AS DATE) AS VARCHAR) AS "month", item_type, {MEASURES_SQL}
FROM comparison GROUP BY 1, 2""")
def monthly_comparison(spark, sf_dir):
    return V.tidy(P.monthly_comparison(comparison(spark, sf_dir)))


@register("slot_totals", f"""WITH {V.FORECAST_SQL}
SELECT CAST("date" AS VARCHAR) AS "date", prediction_slot, item_type, item_subtype,
       CAST(sum(predicted_quantity) AS BIGINT) AS total_predicted,
       CASE WHEN grouping(item_subtype) = 1 THEN 'category' ELSE 'subtype' END AS level
FROM predictions
GROUP BY GROUPING SETS (("date", prediction_slot, item_type), ("date", prediction_slot, item_type, item_subtype))""")
def slot_totals(spark, sf_dir):
    return V.tidy(P.slot_totals(V.predictions(spark, sf_dir)))


@register("slot_payload", f"""WITH {V.FORECAST_SQL}
SELECT {KEYS_SQL}, CAST(predicted_quantity AS BIGINT) AS quantity,
       CAST(sum(predicted_quantity) OVER (PARTITION BY "date", prediction_slot, item_type) AS BIGINT) AS total_predicted
FROM predictions""")
def slot_payload(spark, sf_dir):
    return V.tidy(P.slot_payload(V.predictions(spark, sf_dir)))


NULLED_SQL = """nulled_predictions AS (
  SELECT * REPLACE (CASE WHEN prediction_slot % 2 = 0 THEN item_subtype END AS item_subtype) FROM predictions),
nulled_actuals AS (
  SELECT * REPLACE (CASE WHEN prediction_slot % 2 = 0 THEN item_subtype END AS item_subtype) FROM actuals)"""


def nulled(rows):
    """Every second slot without subtypes."""
    return rows.withColumn("item_subtype", F.when(F.col("prediction_slot") % 2 == 0, F.col("item_subtype")))


@register("forecast_vs_actual_nulls", f"""WITH {V.COMPARISON_SQL}, {NULLED_SQL},
sides AS (
  SELECT "date", prediction_slot, item_type, item_subtype, predicted_quantity, 0 AS actual_quantity
  FROM nulled_predictions
  UNION ALL
  SELECT "date", prediction_slot, item_type, item_subtype, 0, actual_quantity FROM nulled_actuals)
SELECT {KEYS_SQL}, CAST(sum(predicted_quantity) AS BIGINT) AS predicted_quantity,
       CAST(sum(actual_quantity) AS BIGINT) AS actual_quantity FROM sides GROUP BY ALL""")
def forecast_vs_actual_nulls(spark, sf_dir):
    return V.tidy(P.forecast_vs_actual(nulled(V.predictions(spark, sf_dir)), nulled(V.actuals(spark, sf_dir))))


@register("slot_payload_nulls", f"""WITH {V.FORECAST_SQL},
sums AS (
  SELECT "date", prediction_slot, item_type, CASE WHEN prediction_slot % 2 = 0 THEN item_subtype END AS item_subtype,
         CAST(sum(predicted_quantity) AS BIGINT) AS quantity FROM predictions GROUP BY ALL)
SELECT {KEYS_SQL}, quantity,
       CAST(sum(quantity) OVER (PARTITION BY "date", prediction_slot, item_type) AS BIGINT) AS total_predicted
FROM sums""")
def slot_payload_nulls(spark, sf_dir):
    return V.tidy(P.slot_payload(nulled(V.predictions(spark, sf_dir))))


@register("comparison_by_date", f"""WITH {V.COMPARISON_SQL}
SELECT {KEYS_SQL}, predicted_quantity, actual_quantity, difference, accuracy_pct, accuracy_band, {LABEL_SQL}
FROM comparison WHERE "date" = DATE '{DAY}'""")
def comparison_by_date(spark, sf_dir):
    return V.tidy(P.comparison_by_date(V.predictions(spark, sf_dir), V.actuals(spark, sf_dir), DAY))


@register("prediction_stats", f"""WITH {V.FORECAST_SQL}
SELECT CAST("date" AS VARCHAR) AS "date", CAST(sum(predicted_quantity) AS BIGINT) AS total_predicted,
       count(DISTINCT prediction_slot) AS active_slots, count(*) AS total_items
FROM predictions GROUP BY 1""")
def prediction_stats(spark, sf_dir):
    return V.tidy(P.prediction_stats(V.predictions(spark, sf_dir)))
