"""Raw CSV to the clean hourly table.

    spark-submit storeflow/jobs/clean_sales.py --config sales.json --catalog retail
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from storeflow.jobs.config import load_config
from storeflow.operators.cleaning import observed_report, typed_rows
from storeflow.operators.hourly import FORMS, promo_totals
from storeflow.plans.cleaning import clean_hourly_sales
from storeflow.session import WIDE_SETTINGS, delete_path, fresh_path, job_session
from storeflow.sources.tables import ensure_schema, overwrite_table, read_sales_csv
from storeflow.spec import SalesSpec


def stage_typed(raw: DataFrame, spec: SalesSpec) -> tuple[DataFrame, str]:
    """Typed rows as parquet in the shared folder, and their path.

    Finding the promotions, and the forms that aggregate twice, are passes of
    their own. On staged rows these read typed columns and do not parse CSV again.
    """
    path = fresh_path(raw.sparkSession, "typed-sales")
    typed_rows(raw, spec).write.parquet(path)
    return raw.sparkSession.read.parquet(path), path


def run(
    spark: SparkSession,
    config: dict,
    catalog: str = "",
    table_format: str = "parquet",
    promotions: Sequence[str | None] | None = None,
    infer: bool = False,
    form: str = "wide",
    unlisted: str = "error",
) -> DataFrame:
    """Write the clean table; returns the report on missing columns and rejected values.

    With ``form="rows"`` the promotions go to ``<table>_promotions``. The CSV is
    parsed once: the report is taken in passing, and staged rows are deleted.
    """
    spec = SalesSpec.from_config(config)
    raw = read_sales_csv(spark, config["training_data_location"]["dataset"], infer=infer)
    rows, report = observed_report(raw, spec)
    staged = None
    if form != "wide" or promotions is None:
        rows, staged = stage_typed(rows, spec)
    cleaned = clean_hourly_sales(rows, spec, promotions, form, unlisted)
    schema, table = config["schemas"]["base"], config["transformed_target_table"]
    ensure_schema(spark, *[p for p in (catalog, schema) if p])
    overwrite_table(cleaned, catalog, schema, table, table_format=table_format)
    if form == "rows":
        overwrite_table(promo_totals(rows, spec), catalog, schema, f"{table}_promotions", table_format=table_format)
    if staged:
        delete_path(spark, staged)
    return report()


def main() -> None:
    parser = argparse.ArgumentParser(description="clean raw sales")
    parser.add_argument("--config", required=True)
    parser.add_argument("--catalog", default="")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--promotions", nargs="*", help="known promotions, which saves staging the rows")
    parser.add_argument("--null-promotion", action="store_true", help="rows without a promotion are listed, too")
    parser.add_argument("--promotion-form", choices=FORMS, default="wide")
    parser.add_argument("--unlisted", choices=("error", "column"), default="error", help="promotions not listed")
    parser.add_argument("--infer-types", action="store_true", help="read the input once more to guess types")
    args = parser.parse_args()
    spark = job_session("clean-sales", WIDE_SETTINGS)
    promotions = args.promotions
    if promotions is not None and args.null_promotion:
        promotions = [None, *promotions]
    report = run(
        spark, load_config(args.config), args.catalog, args.format, promotions, args.infer_types,
        args.promotion_form, args.unlisted,
    )
    report.filter("not present or rejected > 0").show(500, truncate=False)


if __name__ == "__main__":
    main()
