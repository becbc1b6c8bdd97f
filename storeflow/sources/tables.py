"""CSV and catalog reads, table writes, schema copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeflow.operators.cleaning import col, replace_columns

DELTA_OPTIONS = {
    "overwriteSchema": "true",
    "delta.columnMapping.mode": "name",
    "delta.autoOptimize.optimizeWrite": "true",
    "delta.autoOptimize.autoCompact": "true",
}


CORRUPT = "_corrupt_record"


def read_sales_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    types: Mapping[str, str] | None = None,
    infer: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV files with a header line.

    By default only the header is looked at: all columns are text, and the
    cleaning step types them, so the data is read once. ``types`` converts
    further columns on the way in (unreadable text becomes null). ``infer``
    lets Spark guess all types, which reads the whole input one more time.

    Every file's header is checked: a file whose columns differ from those of
    its path, or come in another order, fails the read. Give such files as
    several paths; each is read by its own header and columns meet by name,
    absent ones null. For a folder in which headers differ there is
    :func:`read_mixed_csv`. ``keep_corrupt`` adds ``_corrupt_record`` with the lines
    that have too few or too many fields.
    """
    if not isinstance(path, str):
        parts = [read_sales_csv(spark, p, types, infer, keep_corrupt) for p in path]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _read_alike(spark, path, types, infer, keep_corrupt)


def _read_alike(
    spark: SparkSession, path: str | list[str], types: Mapping[str, str] | None, infer: bool, keep_corrupt: bool
) -> DataFrame:
    """CSV files that have the same header."""
    options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE"}
    rows = spark.read.csv(path, inferSchema=infer, **options)
    if keep_corrupt:
        schema = T.StructType([*rows.schema.fields, T.StructField(CORRUPT, T.StringType())])
        rows = spark.read.csv(path, schema=schema, columnNameOfCorruptRecord=CORRUPT, **options)
    known = {n: t for n, t in (types or {}).items() if n in rows.columns}
    return replace_columns(rows, {n: col(n).try_cast(t) for n, t in known.items()}) if known else rows


def csv_headers(spark: SparkSession, path: str, pattern: str = "*", parallel: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder by their header: a tuple of column names to paths.

    The names of the files come to the driver. Each header is read by a job that
    takes one line, ``parallel`` of them at a time; compressed files and any
    store that Spark reads will do. Empty files have no header and are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = sorted(r["path"] for r in listed.where("length > 0").select("path").collect())

    def header(file: str) -> tuple[str, ...]:
        return tuple(spark.read.csv(file, header=True, inferSchema=False).columns)

    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        for file, names in zip(files, pool.map(inheritable_thread_target(spark)(header), files)):
            if names:
                found.setdefault(names, []).append(file)
    return found


def read_mixed_csv(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, pattern: str = "*", keep_corrupt: bool = False
) -> DataFrame:
    """A folder of CSV files with different headers: every file is read by its own, columns meet by name.

    Files with the same header are one scan, so the plan has a part for each
    header and not for each file. Columns that a file does not have are null in
    its rows; columns are in the order in which headers first have them, files
    taken by name.
    """
    groups = csv_headers(spark, path, pattern)
    if not groups:
        raise ValueError(f"no file with a header in {path}")
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [_read_alike(spark, files, types, False, keep_corrupt) for files in groups.values()],
    )


def qualified(*parts: str) -> str:
    """A table or schema name with every part quoted; schemas may contain dashes."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def read_table(spark: SparkSession, *name: str) -> DataFrame:
    return spark.read.table(qualified(*name))


def list_tables(spark: SparkSession, *schema: str) -> DataFrame:
    """One row per table of a schema, without temporary views."""
    shown = spark.sql(f"SHOW TABLES IN {qualified(*schema)}")
    return shown.filter(~F.col("isTemporary")).select(F.col("tableName").alias("table_name"))


def ensure_schema(spark: SparkSession, *schema: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {qualified(*schema)}{at}")


def _gathered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a table partition in few tasks, which keeps every task from writing to every partition.

    Unlike ``repartition`` the hint lets adaptive execution split a partition
    that holds much of the data, and merge small ones.
    """
    return df.hint("rebalance", *[col(n) for n in partition_by])


def overwrite_table(
    df: DataFrame,
    *name: str,
    table_format: str = "parquet",
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Replace a table, its columns included.

    ``rebalance`` adds a shuffle that evens out file sizes. It is off by
    default: output of an aggregate already has partitions of the advised size.
    Partitioned tables are always rebalanced, see :func:`_gathered`.
    """
    out = _gathered(df, partition_by) if rebalance or partition_by else df
    writer = out.write.format(table_format).mode("overwrite")
    if table_format == "delta":
        writer = writer.options(**DELTA_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(qualified(*name))


def table_names(spark: SparkSession, schema: Sequence[str]) -> list[str]:
    """Names only: the one result here that comes to the driver."""
    return sorted(r["table_name"] for r in list_tables(spark, *schema).collect())


def copy_schema(
    spark: SparkSession, source: Sequence[str], target: Sequence[str], table_format: str = "parquet", parallel: int = 4
) -> DataFrame:
    """Copy every table of a schema as :func:`copy_report` does; fail when all others are copied, if one cannot be."""
    report = copy_report(spark, source, target, table_format, parallel)
    failed = [f"{r['table_name']}: {r['error']}" for r in report.where("error is not null").collect()]
    if failed:
        raise RuntimeError("not copied: " + "; ".join(failed))
    return report.select("table_name", "rows")


def copy_report(
    spark: SparkSession, source: Sequence[str], target: Sequence[str], table_format: str = "parquet", parallel: int = 4
) -> DataFrame:
    """Copy every table of a schema, replacing the targets; report ``(table_name, rows, error)``.

    ``parallel`` tables are copied at a time, each by a Spark job of its own in a
    scheduler pool of its own, so that small tables fill what a large one leaves
    free (with ``spark.scheduler.mode`` FAIR; otherwise jobs share in order). A
    table that cannot be copied has its error in the report, and no rows; it does
    not keep the others from being copied. Rows are counted while they are written.
    """
    ensure_schema(spark, *target)

    def copy(table: str) -> tuple[str, int | None, str | None]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"copy-{table}")
        try:
            seen = Observation(f"copy_{table}")
            rows = read_table(spark, *source, table).observe(seen, F.count(F.lit(1)).alias("rows"))
            overwrite_table(rows, *target, table, table_format=table_format)
            return table, seen.get["rows"], None
        except (PySparkException, Py4JError) as error:
            return table, None, str(error).strip().splitlines()[0]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(copy), table_names(spark, source)))
    return spark.createDataFrame(done, "table_name string, rows bigint, error string")


def table_inventory(spark: SparkSession, *schema: str) -> DataFrame:
    """Tables of a schema with their row counts."""
    counts = None
    for table in table_names(spark, schema):
        one = read_table(spark, *schema, table).agg(F.count(F.lit(1)).alias("rows"))
        one = one.select(F.lit(table).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionAll(one)
    if counts is None:
        return spark.createDataFrame([], "table_name string, rows bigint")
    return list_tables(spark, *schema).join(counts, "table_name")


def item_catalogue(catalogue: DataFrame) -> DataFrame:
    """Categories with nested subtypes as one row per subtype."""
    return catalogue.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category"),
        F.explode("subtypes").alias("s"),
    ).select("category_id", "category", F.col("s.id").alias("subtype_id"), F.col("s.name").alias("subtype"))


def append_rows(df: DataFrame, *name: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a table, creating it on first use."""
    out = _gathered(df, partition_by) if partition_by else df
    writer = out.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(qualified(*name))


def clear_table(spark: SparkSession, *name: str) -> None:
    """Remove all rows and keep the table."""
    spark.sql(f"TRUNCATE TABLE {qualified(*name)}")


POS_TRANSACTIONS = T.StructType([
    T.StructField("ss_ticket_number", T.LongType()),
    T.StructField("ss_item_sk", T.LongType()),
    T.StructField("ss_store_sk", T.LongType()),
    T.StructField("ss_quantity", T.IntegerType()),
    T.StructField("ss_wholesale_cost", T.DecimalType(12, 2)),
    T.StructField("ss_list_price", T.DecimalType(12, 2)),
    T.StructField("ss_sales_price", T.DecimalType(12, 2)),
    T.StructField("ss_ext_sales_price", T.DecimalType(14, 2)),
    T.StructField("ts", T.TimestampType()),
])
