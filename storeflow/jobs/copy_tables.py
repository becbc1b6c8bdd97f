"""Copy every table of one schema into another.

    spark-submit storeflow/jobs/copy_tables.py --source samples.store --target retail.store
"""

from __future__ import annotations

import argparse

from storeflow.session import job_session
from storeflow.sources.tables import copy_schema


def main() -> None:
    parser = argparse.ArgumentParser(description="copy the tables of a schema")
    parser.add_argument("--source", required=True, help="schema, or catalog.schema")
    parser.add_argument("--target", required=True, help="schema, or catalog.schema")
    parser.add_argument("--format", default="parquet")
    args = parser.parse_args()
    spark = job_session("copy-tables")
    copy_schema(spark, args.source.split("."), args.target.split("."), args.format).show(1000, truncate=False)


if __name__ == "__main__":
    main()
