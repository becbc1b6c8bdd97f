"""Slot totals kept in a table by a stream: every event counts once, however late or often it comes.

A table lives in a folder with five parts:

* ``totals``: slot totals, partitioned by date; read them with :func:`read_totals`.
* ``ledger``: one entry per stream and batch with counts per date. An entry is
  written last: a batch without one has not happened, one with an entry is over.
* ``tickets``: the tickets that have counted, partitioned by date.
* ``late``: events that came behind the watermark or without a time.
* ``staged``: what the batch at work will put in place.

A batch is prepared in ``staged`` from the table as it was; then its dates
replace those of the table, and its entry is written. If it is cut off before
it is prepared, nothing has changed and it starts again; if it is cut off later,
the prepared dates are put in place again. One writer at a time.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storeflow.operators.cleaning import col
from storeflow.session import has_partitions, path_exists, remove_path
from storeflow.sources.partitions import distinct_dates, merge_dates, publish, read_dates, write_dates
from storeflow.streaming.actuals import LATENESS, SLOT

RESERVED = ("ts", "date", "ticket", "quantity", "slot_start", "actual_quantity", "sales", "load", "n")
LEDGER = (
    "date date, events bigint, counted bigint, late bigint, max_ts timestamp, stream_id string, batch_id bigint"
)


def slot_sums(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The slot totals of some events, as a batch, with the date they belong to."""
    slot = F.window(F.col("ts").cast("timestamp"), SLOT).alias("slot")
    summed = events.groupBy(slot, *[col(k) for k in keys]).agg(
        F.sum("quantity").alias("actual_quantity"), F.count(F.lit(1)).alias("sales")
    )
    start = F.col("slot.start").alias("slot_start")
    return summed.select(start, *[col(k) for k in keys], "actual_quantity", "sales", F.to_date("slot.start").alias("date"))


def _added(keys: Sequence[str]):
    """Old and new slot totals to one row per slot and key."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("slot_start", *[col(k) for k in keys], "date").agg(
            F.sum("actual_quantity").alias("actual_quantity"), F.sum("sales").alias("sales")
        ).select("slot_start", *[col(k) for k in keys], "actual_quantity", "sales", "date")

    return combine


def _complete(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/_SUCCESS")


def _entry(path: str, stream_id: str, batch_id: int) -> str:
    return f"{path}/ledger/stream_id={stream_id}/batch_id={batch_id}"


def merge_batch(
    batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], stream_id: str, ticket: str | None = None,
    lateness: str = LATENESS,
) -> None:
    """Add a batch of events (ts, quantity, keys) to the table at ``path``, once.

    A batch is known by its stream and number: a second delivery changes nothing,
    while a stream from a new checkpoint has another id and starts from 0 again.

    With ``ticket``, the events of a ticket on one date count once, within the
    batch and over all batches: the least (ts, keys, quantity) of the batch that
    brings it first. Events without a ticket always count. Late events change
    their old slot; those behind the watermark, which is the latest time of all
    earlier batches less ``lateness``, are also listed in ``late``. Events
    without a time have no slot and are only listed there.

    Only the dates of the batch are read and replaced.
    """
    path = path.rstrip("/")
    if clash := sorted({*RESERVED}.intersection(keys)):
        raise ValueError(f"keys cannot be named {clash}")
    spark, staged = batch.sparkSession, f"{path}/staged/{stream_id}-{batch_id}"
    if not _complete(spark, _entry(path, stream_id, batch_id)):
        if not _complete(spark, f"{staged}/ledger"):
            _prepare(batch, batch_id, path, staged, keys, stream_id, ticket, lateness)
        _put_in_place(spark, path, staged, stream_id, batch_id)
    remove_path(spark, staged)


def _prepare(
    batch: DataFrame, batch_id: int, path: str, staged: str, keys: Sequence[str], stream_id: str, ticket: str | None,
    lateness: str,
) -> None:
    spark = batch.sparkSession
    ts = F.col("ts").cast("timestamp")
    number = col(ticket).cast("string") if ticket else F.lit(None).cast("string")
    fields = [ts.alias("ts"), *[col(k) for k in keys], F.col("quantity"), number.alias("ticket")]
    slot_date = F.to_date(F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 7200) * 7200))
    # The source is read here and nowhere else.
    events = batch.select(*fields, slot_date.alias("date"))
    events.write.mode("overwrite").partitionBy("date").parquet(f"{staged}/events")
    events = spark.read.schema(events.schema).parquet(f"{staged}/events")
    dates = distinct_dates(events)

    timed = events.where(F.col("date").isNotNull())
    first = F.min(F.struct("ts", *[col(k) for k in keys], "quantity")).alias("e")
    tickets_schema = "ticket string, date date, load string"
    known = read_dates(spark, f"{path}/tickets", spark.createDataFrame([], tickets_schema).schema, dates)
    once = (
        timed.where(F.col("ticket").isNotNull()).groupBy("date", "ticket").agg(first)
        .join(known.select("date", "ticket"), ["date", "ticket"], "left_anti")
        .select("e.*", "ticket", "date")
    )
    counted = once.unionAll(timed.where(F.col("ticket").isNull()))
    counted.write.mode("overwrite").partitionBy("date").parquet(f"{staged}/counted")
    counted = spark.read.schema(counted.schema).parquet(f"{staged}/counted")

    new_tickets = counted.where(F.col("ticket").isNotNull()).select("ticket", "date", F.lit(f"{stream_id}-{batch_id}").alias("load"))
    new_tickets.hint("rebalance", "date").write.mode("overwrite").partitionBy("date", "load").parquet(f"{staged}/tickets")
    totals = slot_sums(counted, keys)
    merge_dates(totals, f"{path}/totals", f"{staged}/totals", _added(keys), dates=dates)

    before = _entry(path, stream_id, batch_id - 1)
    latest = F.lit(None).cast("timestamp")
    if batch_id > 0 and _complete(spark, before):
        latest = spark.read.parquet(before).agg(F.max("max_ts")).scalar()
    is_late = F.coalesce(F.col("ts") < latest - F.expr(f"INTERVAL '{lateness}'"), F.lit(False))
    late = counted.where(is_late).withColumn("reason", F.lit("late")).unionAll(
        events.where(F.col("date").isNull()).withColumn("reason", F.lit("no time"))
    )
    late.write.mode("overwrite").parquet(f"{staged}/late")
    counts = counted.groupBy("date").agg(
        F.count("*").alias("counted"), F.sum(is_late.cast("bigint")).alias("late")
    )
    seen = events.groupBy("date").agg(F.count("*").alias("events"))
    newest = F.greatest(events.agg(F.max("ts")).scalar(), latest)
    # A row for each date, and always one without a date, for the events without a time.
    per_date = seen.unionAll(spark.createDataFrame([(None, 0)], "date date, events bigint")).groupBy("date").agg(
        F.sum("events").alias("events")
    )
    per_date.join(counts, "date", "left").na.fill(0, ["counted", "late"]).select(
        "date", "events", "counted", "late", newest.alias("max_ts")
    ).coalesce(1).write.mode("overwrite").parquet(f"{staged}/ledger")


def _put_in_place(spark: SparkSession, path: str, staged: str, stream_id: str, batch_id: int) -> None:
    for part, by in (("totals", ["date"]), ("tickets", ["date", "load"])):
        if has_partitions(spark, f"{staged}/{part}"):
            schema = spark.read.parquet(f"{staged}/{part}").schema
            publish(spark, f"{staged}/{part}", f"{path}/{part}", schema, by)
    late = spark.read.parquet(f"{staged}/late")
    late.write.mode("overwrite").parquet(f"{path}/late/stream_id={stream_id}/batch_id={batch_id}")
    spark.read.parquet(f"{staged}/ledger").coalesce(1).write.mode("overwrite").parquet(_entry(path, stream_id, batch_id))


def upsert_stream(
    events: DataFrame, path: str, checkpoint: str, keys: Sequence[str], available_now: bool = True,
    ticket: str | None = None, lateness: str = LATENESS,
) -> StreamingQuery:
    """Keep the table of slot totals at ``path`` up to date; see :func:`merge_batch`.

    The stream is known by the id of its query, which its checkpoint keeps over restarts.
    """
    started, name = threading.Event(), []

    def merge(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        merge_batch(batch, batch_id, path, keys, name[0], ticket, lateness)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    query = writer.trigger(availableNow=True).start() if available_now else writer.start()
    name.append(str(query.id))
    started.set()
    return query


def load_backlog(events: DataFrame, path: str, keys: Sequence[str], ticket: str | None = None, name: str | None = None) -> str:
    """Add older events in any order as one batch, before, between or after streams; return its name.

    The name defaults to a digest of the rows, so that loading the same rows
    again changes nothing and other rows are another backlog.
    """
    if name is None:
        row = events.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64(*[col(c) for c in events.columns]).cast("decimal(38,0)")).alias("h")
        ).first()
        name = f"backlog-{row['n']}-{int(row['h'] or 0) % 10**16}"
    merge_batch(events, 0, path, keys, name, ticket)
    return name


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/totals")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Per stream, batch and date: events delivered, counted and late, and the latest time so far."""
    return spark.read.schema(LEDGER).parquet(f"{path.rstrip('/')}/ledger")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Events that came behind the watermark (they count) or without a time (they do not)."""
    return spark.read.parquet(f"{path.rstrip('/')}/late")


def event_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per stream, over all its batches: events, counted, repeated, late and without a time."""
    no_time = F.when(F.col("date").isNull(), F.col("events")).otherwise(0)
    return read_ledger(spark, path).groupBy("stream_id").agg(
        F.sum("events").alias("events"), F.sum("counted").alias("counted"),
        F.sum(F.col("events") - F.col("counted") - no_time).alias("repeated"), F.sum("late").alias("late"),
        F.sum(no_time).alias("no_time"),
    )


def pack_tickets(spark: SparkSession, path: str, dates: Sequence) -> None:
    """Put the tickets of these dates, a file per batch and date, in one folder per date.

    In between a ticket may stand in both places, which changes nothing.
    """
    table, staged = f"{path.rstrip('/')}/tickets", f"{path.rstrip('/')}/staged/tickets"
    schema = spark.createDataFrame([], "ticket string, date date, load string").schema
    old = read_dates(spark, table, schema, dates)
    loads = [(r["date"], r["load"]) for r in old.select("date", "load").distinct().where("load <> 'packed'").collect()]
    packed = old.select("ticket", "date").distinct().withColumn("load", F.lit("packed"))
    packed.write.mode("overwrite").partitionBy("date", "load").parquet(staged)
    write_dates(spark.read.schema(schema).parquet(staged), table, ["date", "load"])
    for date, load in loads:
        remove_path(spark, f"{table}/date={date}/load={load}")
    remove_path(spark, staged)


def forget_tickets(spark: SparkSession, path: str, before) -> None:
    """Delete the tickets of dates before ``before``; should one of them come again, it counts again."""
    table = f"{path.rstrip('/')}/tickets"
    schema = spark.createDataFrame([], "ticket string, date date, load string").schema
    rows = spark.read.schema(schema).parquet(table).where(F.col("date") < F.lit(before))
    for date in distinct_dates(rows):
        remove_path(spark, f"{table}/date={date}")
