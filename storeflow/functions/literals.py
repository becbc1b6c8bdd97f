"""Small constant tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """Constant rows made from literals, so that no Python worker is needed to read them."""
    if not rows:
        raise ValueError("a constant table needs at least one row")
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))
