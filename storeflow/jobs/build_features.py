"""The clean hourly table to the feature table, with the fitted tables beside it.

    spark-submit storeflow/jobs/build_features.py --config sales.json --catalog retail
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from storeflow.jobs.config import load_config
from storeflow.plans.features import fit_features, fitted_steps, model_features
from storeflow.session import WIDE_SETTINGS, job_session
from storeflow.sources.tables import ensure_schema, overwrite_table, read_table
from storeflow.spec import SalesSpec


def run(
    spark: SparkSession, config: dict, catalog: str = "", table_format: str = "parquet", refit: bool = True
) -> None:
    """Write ``<table>_final``, ``<table>_scaler`` and ``<table>_labels``.

    Without ``refit`` the stored scaler and labels are used, so that new rows
    are encoded like the old ones.
    """
    spec = SalesSpec.from_config(config)
    table = config["transformed_target_table"]
    schema = config["schemas"]["processed"]
    hourly = read_table(spark, catalog, config["schemas"]["base"], table)
    ensure_schema(spark, *[p for p in (catalog, schema) if p])
    needs_scaler, needs_labels = fitted_steps(hourly, spec)
    if refit:
        scaler, labels = fit_features(hourly, spec)
        if needs_scaler:
            overwrite_table(scaler, catalog, schema, f"{table}_scaler", table_format=table_format)
        if needs_labels:
            overwrite_table(
                labels, catalog, schema, f"{table}_labels", table_format=table_format, partition_by=["column"]
            )
    features = model_features(
        hourly,
        spec,
        read_table(spark, catalog, schema, f"{table}_scaler") if needs_scaler else None,
        read_table(spark, catalog, schema, f"{table}_labels") if needs_labels else None,
    )
    overwrite_table(features, catalog, schema, f"{table}_final", table_format=table_format)


def main() -> None:
    parser = argparse.ArgumentParser(description="build model features")
    parser.add_argument("--config", required=True)
    parser.add_argument("--catalog", default="")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--keep-fitted", action="store_true", help="use the stored scaler and labels")
    args = parser.parse_args()
    spark = job_session("build-features", WIDE_SETTINGS)
    run(spark, load_config(args.config), args.catalog, args.format, refit=not args.keep_fitted)


if __name__ == "__main__":
    main()
