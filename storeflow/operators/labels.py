"""Label dictionaries: values ranked by frequency, kept as a table.

The dictionary of an item or store column can hold many millions of values, so
it is never ranked in one task: values are range-sorted over all partitions,
numbered per partition, and shifted by the number of values before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeflow.operators.cleaning import col, present
from storeflow.session import fresh_path

# monotonically_increasing_id keeps the row's position in its low 33 bits.
POSITION_BITS = 33
# Up to so many labels, counted, a dictionary is small: some MB on disk.
BROADCAST_LABELS = 200_000


def label_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of all columns in one scan and one shuffle.

    Equal values are counted on the map side, so a value that fills a third of
    the rows costs one row per task.
    """
    wanted = present(df, names)
    if not wanted:
        raise ValueError("none of the columns to label exists")
    text = df.select(*[col(n).cast("string").alias(n) for n in wanted])
    long = text.unpivot([], [col(n) for n in wanted], "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def fit_labels(df: DataFrame, names: Sequence[str], path: str | None = None) -> DataFrame:
    """``labels(column, value, n, idx, n_labels)``, written to ``path``.

    Index 0 is the most frequent value; equal counts follow text order, also
    for numbers. ``path`` defaults to a new place in the shared folder. The
    sorted rows are written before they are numbered: positions must not change
    when a lost task is run again.
    """
    spark = df.sparkSession
    staged_path = fresh_path(spark, "label-order")
    ranked = label_counts(df, names).orderBy("column", F.col("n").desc(), "value")
    ranked.withColumn("at", F.monotonically_increasing_id()).write.parquet(staged_path)
    staged = (
        spark.read.parquet(staged_path)
        .withColumn("part", F.shiftright("at", POSITION_BITS))
        .withColumn("position", F.col("at").bitwiseAND((1 << POSITION_BITS) - 1))
    )

    # Range partitions do not overlap: at most one row per partition plus one
    # per column, whatever the number of values. That bound allows the broadcast.
    pieces = staged.groupBy("column", "part").agg(
        F.count("*").alias("size"), F.min("position").alias("first")
    )
    by_column = Window.partitionBy("column")
    earlier = by_column.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "column",
        "part",
        "first",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
        F.sum("size").over(by_column).alias("n_labels"),
    )
    labels = staged.join(F.broadcast(starts), ["column", "part"]).select(
        "column",
        "value",
        "n",
        (F.col("start") + F.col("position") - F.col("first")).cast("int").alias("idx"),
        F.col("n_labels").cast("int").alias("n_labels"),
    )
    # One folder per column: a lookup reads one column's files, and their size
    # tells Catalyst whether that dictionary can be broadcast.
    target = path or fresh_path(spark, "labels")
    labels.write.mode("overwrite").partitionBy("column").parquet(target)
    return read_labels(spark, target)


def read_labels(spark, path: str) -> DataFrame:
    schema = "value string, n bigint, idx int, n_labels int, column string"
    return spark.read.schema(schema).parquet(path).select("column", "value", "n", "idx", "n_labels")


def label_sizes(labels: DataFrame) -> dict[str, int]:
    """How many labels each column has: one small row per column."""
    return {r["column"]: r["n"] for r in labels.groupBy("column").agg(F.max("n_labels").alias("n")).collect()}


def apply_labels(
    df: DataFrame, labels: DataFrame, names: Sequence[str], strict: bool = True, distinct_first: bool = False,
    large: Sequence[str] | None = None, broadcast_labels: int = BROADCAST_LABELS,
) -> DataFrame:
    """Replace values by their index; null and unseen values get ``n_labels``.

    The rows are shuffled once at most, whatever the number of columns. Columns
    with up to ``broadcast_labels`` labels, which are counted, are joined to
    their dictionaries, which Catalyst broadcasts by their size on disk. Where
    several have more, or where the session broadcasts nothing, their distinct
    combinations are labelled first and the rows are joined to those. Adaptive
    execution splits the rows of a hot combination. ``large`` names the columns
    for that join instead of counting, and ``distinct_first`` names them all:
    then nothing is run before the result is.

    A column without any stored label fails the query, as it was never fitted.
    ``strict=False`` gives 0 instead, which suits labels fitted on the same
    rows, where such a column is null throughout.
    """
    wanted = present(df, names)
    if distinct_first or not broadcasts(df.sparkSession):
        large = wanted
    elif large is None:
        counted = label_sizes(labels)
        large = [n for n in wanted if counted.get(n, 0) > broadcast_labels]
    big = [n for n in wanted if n in set(large)]
    if len(big) < 2:
        return _by_dictionary(df, labels, wanted, strict) if wanted else df
    small = [n for n in wanted if n not in set(big)]
    coded = _by_dictionary(df, labels, small, strict) if small else df
    return _by_combination(coded, labels, big, strict)


def broadcasts(spark) -> bool:
    """Whether the session broadcasts sides of joins by their size at all."""
    return not str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().startswith(("-", "0"))


def _by_dictionary(df: DataFrame, labels: DataFrame, wanted: Sequence[str], strict: bool) -> DataFrame:
    """One left join per column with its dictionary."""

    def size(name: str, i: int) -> Column:
        known = F.max(F.when(F.col("column") == name, F.col("n_labels")))
        missing = F.raise_error(F.lit(f"the stored labels have no column {name}")).cast("int") if strict else F.lit(0)
        return F.coalesce(known, missing).alias(f"c{i}")

    sizes = labels.agg(F.struct(*[size(n, i) for i, n in enumerate(wanted)]).alias("sizes")).scalar()
    made, joined = {}, df
    for i, name in enumerate(wanted):
        entries = labels.filter(F.col("column") == name).select(
            F.col("value").alias(f"__value{i}"), F.col("idx").alias(f"__idx{i}")
        )
        joined = joined.join(entries, col(name).cast("string") == F.col(f"__value{i}"), "left")
        made[name] = F.coalesce(F.col(f"__idx{i}"), sizes[f"c{i}"]).alias(name)
    return joined.select(*[made[n] if n in made else col(n) for n in df.columns])


def _by_combination(df: DataFrame, labels: DataFrame, wanted: Sequence[str], strict: bool) -> DataFrame:
    """Label the distinct combinations of some columns, and join the rows to them once."""
    keys = [col(n).cast("string").alias(f"__key{i}") for i, n in enumerate(wanted)]
    combined = df.select("*", F.struct(*keys).alias("__keys"))
    found = df.select(*[k.alias(n) for k, n in zip(keys, wanted)]).distinct()
    found = found.select(F.struct(*[col(n).alias(f"__key{i}") for i, n in enumerate(wanted)]).alias("__found"), "*")
    coded = _by_dictionary(found, labels, wanted, strict)
    coded = coded.select("__found", *[col(n).alias(f"__idx{i}") for i, n in enumerate(wanted)])
    joined = combined.join(coded, F.col("__keys").eqNullSafe(F.col("__found")), "left")
    made = {n: F.col(f"__idx{i}").alias(n) for i, n in enumerate(wanted)}
    return joined.select(*[made[n] if n in made else col(n) for n in df.columns])


def label_encode(df: DataFrame, names: Sequence[str], path: str | None = None) -> DataFrame:
    """Fit on the rows and apply to the same rows."""
    return apply_labels(df, fit_labels(df, names, path), names, strict=False)
