"""Scaling, label dictionaries and the feature job as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from storeflow.operators import labels as L
from storeflow.operators import scaling as Z
from storeflow.plans.cleaning import clean_hourly_sales
from storeflow.plans.features import model_features
from storeflow.registry import register
from storeflow.registry import views as V
from storeflow.registry.hourly import HOUR_TEXT, HOURS_SQL
from storeflow.registry.rows import CALENDAR_SQL
from storeflow.session import fresh_path

SCALED = ("Gross_sales", "avg_sell_price", "promo_amount", "HOLD_TIME", "sales_unit_qty")
LABELLED = ("cat_id", "ITEM_UNIT", "County", "Flow", "Item Slin")


def _each(names, text: str) -> str:
    return "\nUNION ALL ".join(text.format(n=n) for n in names)


STATS_SQL = _each(SCALED, """SELECT '{n}' AS feature, round(avg("{n}"), 4) AS mean,
       round(stddev_samp("{n}"), 4) AS std FROM retail""")


@register("feature_stats", f"WITH {V.RETAIL_SQL}\n{STATS_SQL}")
def feature_stats(spark, sf_dir):
    return V.tidy(Z.fit_scaler(V.retail(spark, sf_dir), SCALED), {"mean": 4, "std": 4})


DAY_SCALED = ("l_quantity", "l_extendedprice", "l_discount")


@register("feature_stats_merged", _each(DAY_SCALED, """SELECT '{n}' AS feature, round(avg({n}), 4) AS mean,
       round(stddev_samp({n}), 4) AS std FROM lineitem"""))
def feature_stats_merged(spark, sf_dir):
    """Moments per day: most days at once, then the last ones, then order lines of old days that were missing."""
    rows = V.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_linenumber", *DAY_SCALED)
    path = fresh_path(spark, "moments")
    late, recent = F.col("l_linenumber") == 3, F.col("date") >= F.lit("1996-01-01").cast("date")
    for part in (rows.where(~recent & ~late), rows.where(recent), rows.where(~recent & late)):
        Z.add_moments(part, DAY_SCALED, path)
    return V.tidy(Z.moments_scaler(Z.read_moments(spark, path)), {"mean": 4, "std": 4})


def _z(name: str, digits: int = 6) -> str:
    return (f"""round(CASE WHEN stddev_samp("{name}") OVER () <> 0
       THEN ("{name}" - avg("{name}") OVER ()) / stddev_samp("{name}") OVER ()
       ELSE "{name}" - avg("{name}") OVER () END, {digits}) + 0.0 AS "{name}\"""")


@register("standard_scale", f"""WITH {V.RETAIL_SQL}
SELECT l_orderkey, l_linenumber, {", ".join(_z(n, 4) for n in SCALED)} FROM retail""")
def standard_scale(spark, sf_dir):
    rows = V.retail(spark, sf_dir).select("l_orderkey", "l_linenumber", *SCALED)
    return V.tidy(Z.standard_scale(rows, SCALED), {n: 4 for n in SCALED})


def labels_sql(names) -> str:
    long = _each(names, """SELECT '{n}' AS "column", CAST("{n}" AS VARCHAR) AS value FROM retail""")
    return f"""{V.RETAIL_SQL},
long AS ({long}),
counted AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY "column", value),
labels AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) - 1 AS INTEGER) AS idx,
         CAST(count(*) OVER (PARTITION BY "column") AS INTEGER) AS n_labels FROM counted)"""


@register("label_dictionary", f"""WITH {labels_sql(LABELLED)}
SELECT "column", value, n, idx, n_labels FROM labels""")
def label_dictionary(spark, sf_dir):
    return L.fit_labels(V.retail(spark, sf_dir), LABELLED)


@register("label_rank", """WITH counted AS (
  SELECT regexp_extract(props, '[0-9]+') AS value, count(*) AS n FROM events GROUP BY 1)
SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS idx FROM counted""")
def label_rank(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    numbers = V.table(spark, sf_dir, "events").select(k.alias("k"))
    return L.fit_labels(numbers, ["k"]).select("value", "n", "idx")


@register("label_encode", f"""WITH {labels_sql(LABELLED)},
sizes AS (SELECT "column", max(n_labels) AS n_labels FROM labels GROUP BY "column")
SELECT l_orderkey, l_linenumber,
       {", ".join(f'''coalesce(x{i}.idx, (SELECT n_labels FROM sizes WHERE "column" = '{n}')) AS "{n}"'''
                  for i, n in enumerate(LABELLED))}
FROM retail {" ".join(f'''LEFT JOIN labels x{i} ON x{i}."column" = '{n}'
  AND x{i}.value = CAST(retail."{n}" AS VARCHAR)''' for i, n in enumerate(LABELLED))}""")
def label_encode(spark, sf_dir):
    rows = V.retail(spark, sf_dir).select("l_orderkey", "l_linenumber", *LABELLED)
    return L.label_encode(rows, LABELLED)


@register("label_encode_distinct", f"""WITH {labels_sql(LABELLED)},
sizes AS (SELECT "column", max(n_labels) AS n_labels FROM labels GROUP BY "column")
SELECT l_orderkey, l_linenumber,
       {", ".join(f'''coalesce(x{i}.idx, (SELECT n_labels FROM sizes WHERE "column" = '{n}')) AS "{n}"'''
                  for i, n in enumerate(LABELLED))}
FROM retail {" ".join(f'''LEFT JOIN labels x{i} ON x{i}."column" = '{n}'
  AND x{i}.value = CAST(retail."{n}" AS VARCHAR)''' for i, n in enumerate(LABELLED))}""")
def label_encode_distinct(spark, sf_dir):
    rows = V.retail(spark, sf_dir).select("l_orderkey", "l_linenumber", *LABELLED)
    return L.apply_labels(rows, L.fit_labels(rows, LABELLED), LABELLED, distinct_first=True)


FEATURE_CALENDAR = ("hour", "dayofweek", "month", "weekofyear")
FEATURE_SCALED = ("Gross_sales", "avg_sell_price", "promo_quantity", "sales_unit_qty")
FEATURE_LABELS = ("store_id", "item_id", "cat_id", "Holidays")


def _feature_columns() -> str:
    from storeflow.functions.calendar import PERIODS

    made = []
    for part in FEATURE_CALENDAR:
        for function in ("sin", "cos"):
            angle = f"2 * pi() * ({CALENDAR_SQL[part]}) / {PERIODS[part]}"
            made.append(f"round({function}({angle}), 6) + 0.0 AS transaction_timestamp_{part}_{function}")
    for part in ("quarter", "year"):
        made.append(f"CAST({CALENDAR_SQL[part]} AS INTEGER) AS transaction_timestamp_{part}")
    made += [_z(n) for n in FEATURE_SCALED]
    made += [f'x_{n}.idx AS "{n}"' for n in FEATURE_LABELS]
    made += [f'feature_promo_{p} AS "feature_promo_{p.upper()}"' for p in V.PROMOTIONS]
    return ",\n       ".join(made)


def _feature_labels() -> str:
    return ",\n".join(f"""d_{n} AS (
  SELECT "{n}" AS value, CAST(row_number() OVER (ORDER BY count(*) DESC, "{n}") - 1 AS INTEGER) AS idx
  FROM clean GROUP BY "{n}")""" for n in FEATURE_LABELS)


@register("model_features", f"""WITH {HOURS_SQL},
clean AS (
  SELECT store_id, item_id, hour_start AS t, hour_start, ln(1 + sales_unit_qty) AS sales_unit_qty,
         "Gross_sales", avg_sell_price, coalesce(promo_quantity, 0) AS promo_quantity,
         coalesce(upper(cat_id), 'UNKNOWN') AS cat_id, coalesce(upper("Holidays"), 'No_Holiday') AS "Holidays",
         CAST(upper(trim("PERISHABLE")) = 'Y' AS INTEGER) AS "PERISHABLE",
         {", ".join(f"feature_promo_{p}" for p in V.PROMOTIONS)}
  FROM hourly JOIN promo USING (store_id, item_id, hour_start)
  WHERE sales_unit_qty >= 0 AND "Gross_sales" >= 0),
{_feature_labels()}
SELECT {HOUR_TEXT}, "PERISHABLE", {_feature_columns()}
FROM clean {" ".join(f'JOIN d_{n} x_{n} ON x_{n}.value = clean."{n}"' for n in FEATURE_LABELS)}""")
def features(spark, sf_dir):
    upper = [p.upper() for p in V.PROMOTIONS]
    path = fresh_path(spark, "hourly-sales")
    clean_hourly_sales(V.pos(spark, sf_dir), V.POS_SPEC, upper).write.parquet(path)
    made = model_features(spark.read.parquet(path), V.POS_SPEC)
    return V.tidy(made, {f"feature_promo_{p}": 2 for p in upper})
