"""Roll-up of sales rows to one row per group and hour, with promotion features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeflow.operators.cleaning import add_hour, col, replace_columns, restore_time_column
from storeflow.spec import SalesSpec

HOUR = "__hour"
PROMO_PREFIX = "feature_promo_"

PROMO_MAP = "feature_promo"
OTHER = "other"
FORMS = ("wide", "map", "rows")


def keyed_rows(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Rows with their hour; promotions as text, which is what names the columns."""
    rows = add_hour(df, spec.time_column, HOUR)
    if spec.promotion not in df.columns:
        return rows
    return replace_columns(rows, {spec.promotion: col(spec.promotion).cast("string")})


def first_non_null(name: str, spec: SalesSpec) -> Column:
    """The earliest non-null value of a column within its group.

    Rows of the same time are told apart by the row id, or by the value where
    the feed has no row id, so the pick does not depend on partitioning. It is
    the minimum of (time, row id, value), with null for rows to leave out, and
    combines on the map side: a group of any size reaches the reducer as one
    row per task.
    """
    order = [spec.time_column, spec.row_id] if spec.row_id else [spec.time_column]
    ranked = F.struct(*[col(n).alias(f"o{i}") for i, n in enumerate(order)], col(name).alias("value"))
    return F.min(F.when(col(name).isNotNull(), ranked))["value"]


def group_policy(df: DataFrame, spec: SalesSpec) -> list[Column]:
    """One aggregate per column: sums, means, and first non-null for the rest."""
    special = {spec.time_column, spec.promotion, spec.row_id, HOUR, *spec.group_keys}

    def aggregate(name: str) -> Column:
        if name in spec.sum_columns:
            return F.sum(col(name))
        if name in spec.mean_columns:
            return F.avg(col(name))
        return first_non_null(name, spec)

    return [aggregate(n).alias(n) for n in df.columns if n not in special]


# Texts that could be taken for the name of null: ``null`` in any case, also in quotes.
NULL_LIKE = "^'*null'*$"


def promo_key(name: Column) -> Column:
    """A promotion as a text of its own: ``null`` for none, and the text null in quotes."""
    like_null = F.lower(name).rlike(NULL_LIKE)
    return F.when(name.isNull(), "null").when(like_null, F.concat(F.lit("'"), name, F.lit("'"))).otherwise(name)


def promo_name(value: str | None) -> str:
    """The column of a promotion: ``feature_promo_null`` for none, ``feature_promo_'null'`` for that text."""
    if value is None:
        return f"{PROMO_PREFIX}null"
    return PROMO_PREFIX + (f"'{value}'" if re.match(NULL_LIKE, value.lower()) else value)


def promo_columns(values: Sequence[str | None]) -> list[str]:
    """The columns of some promotions; names are compared without case, so values that differ in it only are refused."""
    named: dict[str, str | None] = {}
    for value in values:
        key = promo_name(value).lower()
        if key in named:
            raise ValueError(
                f"the promotions {named[key]!r} and {value!r} cannot both be columns: write them alike, or use form map or rows"
            )
        named[key] = value
    return [promo_name(v) for v in values]


def promotion_values(df: DataFrame, spec: SalesSpec) -> list[str | None]:
    """The promotions in the data, null first: the columns of the wide form.

    Their names come to the driver, as the names of any columns must. For
    promotions without a natural bound there are the forms with maps or rows.
    """
    return [r["p"] for r in df.select(col(spec.promotion).cast("string").alias("p")).distinct().orderBy("p").collect()]


def listed_rows(
    keyed: DataFrame, spec: SalesSpec, promotions: Sequence[str | None], unlisted: str
) -> tuple[DataFrame, list[str | None]]:
    """Rows and columns for a given list of promotions.

    A quantity of a promotion that is not listed is never dropped: with
    ``unlisted="error"`` it fails the query, with ``"column"`` it is added up
    in a column of its own, ``feature_promo_other``.
    """
    if unlisted not in ("error", "column"):
        raise ValueError(f"unlisted must be error or column, not {unlisted}")
    values = list(dict.fromkeys(promotions))
    if unlisted == "column" and OTHER in values:
        raise ValueError(f"a promotion named {OTHER} leaves no name for the unlisted ones")
    name = col(spec.promotion)
    known = F.coalesce(name.isin([v for v in values if v is not None]), F.lit(False))
    if None in values:
        known = known | name.isNull()
    if unlisted == "column":
        lost, values = F.lit(OTHER), [*values, OTHER]
    else:
        lost = F.raise_error(F.concat(F.lit("promotion is not listed: "), F.coalesce(name, F.lit("null")))).cast("string")
    counts = col(spec.promotion_quantity).isNotNull()
    return replace_columns(keyed, {spec.promotion: F.when(~known & counts, lost).otherwise(name)}), values


def promo_sums(spec: SalesSpec, promotions: Sequence[str | None]) -> list[Column]:
    """Quantity per promotion as conditional sums.

    Groups without the promotion get 0. Groups with a null key get null: keys
    are compared as a join would compare them.
    """
    keyed = F.lit(True)
    for key in (*spec.group_keys, HOUR):
        keyed = keyed & col(key).isNotNull()
    quantity = col(spec.promotion_quantity)

    def total(value: str | None) -> Column:
        hit = col(spec.promotion).isNull() if value is None else col(spec.promotion) == value
        return F.when(keyed, F.coalesce(F.sum(F.when(hit, quantity)), F.lit(0)))

    return [total(v).alias(name) for v, name in zip(promotions, promo_columns(promotions))]


def hourly_agg(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Group by the keys and the hour, without promotion features."""
    keyed = keyed_rows(df, spec)
    rows = keyed.groupBy(*[col(k) for k in spec.group_keys], HOUR).agg(*group_policy(keyed, spec))
    return restore_time_column(rows, spec.time_column, HOUR)


def promo_totals(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Promotion quantities as rows: the form for any number of promotions."""
    keyed = keyed_rows(df, spec)
    rows = keyed.groupBy(*[col(k) for k in spec.group_keys], HOUR, col(spec.promotion)).agg(
        F.coalesce(F.sum(col(spec.promotion_quantity)), F.lit(0)).alias(spec.promotion_quantity)
    )
    return restore_time_column(rows, spec.time_column, HOUR)


def promo_map(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Promotion quantities as one map ``feature_promo`` per group: promotion to quantity, by :func:`promo_key`.

    Quantities are added up per promotion first, so a map has an entry for each
    promotion of one group and hour, and never grows with the rows.
    """
    name = promo_key(col(spec.promotion))
    keys = [col(k) for k in (*spec.group_keys, spec.time_column)]
    entry = F.struct(name.alias("promotion"), col(spec.promotion_quantity).alias("quantity"))
    totals = promo_totals(df, spec)
    return totals.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(PROMO_MAP))


def promo_pivot(
    df: DataFrame, spec: SalesSpec, promotions: Sequence[str | None] | None = None, unlisted: str = "error"
) -> DataFrame:
    """Promotion quantities as columns ``feature_promo_<id>``, empty cells 0."""
    keyed = keyed_rows(df, spec)
    if promotions is None:
        values = promotion_values(df, spec)
    else:
        keyed, values = listed_rows(keyed, spec, promotions, unlisted)
    names = promo_columns(values)
    # Pivoted under numbers: the values themselves may not do as column names.
    place = F.lit(None).cast("int")
    for i, value in enumerate(values):
        hit = col(spec.promotion).isNull() if value is None else col(spec.promotion) == value
        place = F.when(hit, i).otherwise(place)
    rows = (
        replace_columns(keyed, {spec.promotion: place}).groupBy(*[col(k) for k in spec.group_keys], HOUR)
        .pivot(spec.promotion, list(range(len(values))))
        .agg(F.sum(col(spec.promotion_quantity)))
    )
    cells = [F.coalesce(col(str(i)), F.lit(0)).alias(name) for i, name in enumerate(names)]
    filled = rows.select(*[col(k) for k in spec.group_keys], HOUR, *cells)
    return restore_time_column(filled, spec.time_column, HOUR)


def promo_left_join(
    df: DataFrame, spec: SalesSpec, promotions: Sequence[str | None] | None = None, unlisted: str = "error"
) -> DataFrame:
    """Roll-up and promotion columns as two aggregates joined on the keys.

    Same rows as the wide form of :func:`hourly_sales`. Both sides are unique on
    the keys, so the join cannot skew.
    """
    keys = [*spec.group_keys, spec.time_column]
    return hourly_agg(df, spec).join(promo_pivot(df, spec, promotions, unlisted), keys, "left")


def hourly_sales(
    df: DataFrame, spec: SalesSpec, promotions: Sequence[str | None] | None = None, form: str = "wide",
    unlisted: str = "error",
) -> DataFrame:
    """Roll-up with promotion features in the chosen ``form``, for any number of promotions.

    ``wide``: a column for each promotion, in one scan and one shuffle without a
    join. Pass the promotions when they are known; otherwise one extra pass over
    that single column finds them. ``unlisted`` is for those not passed.
    ``map``: one map column, see :func:`promo_map`, joined on the unique keys.
    ``rows``: no promotion column here; :func:`promo_totals` has them as rows.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form}")
    if form == "rows" or spec.promotion not in df.columns or spec.promotion_quantity not in df.columns:
        return hourly_agg(df, spec)
    if form == "map":
        keys = [*spec.group_keys, spec.time_column]
        joined = hourly_agg(df, spec).join(promo_map(df, spec), keys, "left")
        rest = [n for n in joined.columns if n != spec.time_column]
        return joined.select(*[col(n) for n in rest], col(spec.time_column))
    keyed = keyed_rows(df, spec)
    if promotions is None:
        values = promotion_values(df, spec)
    else:
        keyed, values = listed_rows(keyed, spec, promotions, unlisted)
    rows = keyed.groupBy(*[col(k) for k in spec.group_keys], HOUR).agg(
        *group_policy(keyed, spec), *promo_sums(spec, values)
    )
    return restore_time_column(rows, spec.time_column, HOUR)
