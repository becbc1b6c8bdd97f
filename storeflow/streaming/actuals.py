"""POS event streams: slot totals, repeated tickets, running totals. Tables kept by a stream: ``upserts``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

LATENESS = "2 hours"
SLOT = "2 hours"


def read_events(
    spark: SparkSession, schema: T.StructType, source: str = "parquet", **options: str
) -> DataFrame:
    """Events from files, or from Kafka as JSON values of the same schema.

    File sources take ``path`` among the options. The Kafka source needs the
    Spark Kafka package on the class path.
    """
    if source == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        parsed = F.from_json(F.col("value").cast("string"), schema)
        return raw.select(parsed.alias("event")).select("event.*")
    return spark.readStream.format(source).schema(schema).options(**options).load()


def with_lateness(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Watermark on ``ts``; wall-clock times are turned into instants first."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def slot_actuals(events: DataFrame, keys: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """Units per two-hour slot and key; later events than the watermark are dropped.

    State holds one row per open slot and key. Partial sums are merged per task
    before the shuffle, so a hot item costs one row per task and batch.
    """
    return slot_totals_of(with_lateness(events, lateness), keys)


def slot_totals_of(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The slot totals of events that already have a watermark, such as deduplicated ones."""
    totals = events.groupBy(F.window("ts", SLOT).alias("slot"), *keys)
    summed = totals.agg(F.sum("quantity").alias("actual_quantity"), F.count(F.lit(1)).alias("sales"))
    return summed.select(F.col("slot.start").alias("slot_start"), *keys, "actual_quantity", "sales")


def dedupe_tickets(events: DataFrame, ticket: str, lateness: str = LATENESS) -> DataFrame:
    """Every ticket once, however often it is delivered within the lateness."""
    return with_lateness(events, lateness).dropDuplicatesWithinWatermark([ticket])


def running_stats(events: DataFrame) -> DataFrame:
    """Transactions, units and revenue so far."""
    return events.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("quantity").alias("total_items_sold"),
        F.sum("amount").alias("total_revenue"),
    )


def write_changes(
    totals: DataFrame, path: str, checkpoint: str, mode: str = "update", available_now: bool = True
) -> StreamingQuery:
    """Write each batch's changed totals to its own folder ``batch_id=<n>``.

    A batch that is run again replaces its own folder, so a restart neither
    loses nor repeats anything. :func:`latest_totals` reads the current state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = totals.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def latest_totals(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest totals of every key among the written batches."""
    measures = [n for n in schema.names if n not in keys]
    logged = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    changes = spark.read.schema(logged).parquet(path)
    newest = F.max_by(F.struct(*measures), "batch_id")
    return changes.groupBy(*keys).agg(newest.alias("t")).select(*keys, "t.*")


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows a query with a watermark has dropped as too late, over its recent batches."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress for operator in progress["stateOperators"]
    )


def write_rows(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append rows to parquet files, exactly once."""
    writer = (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
