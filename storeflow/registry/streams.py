"""The streaming jobs, run over the events table until all of it is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from storeflow.functions.slots import slot_of
from storeflow.registry import register
from storeflow.registry import views as V
from storeflow.session import fresh_path
from storeflow.streaming import actuals as A
from storeflow.streaming import upserts as U


def event_stream(spark, sf_dir):
    """The events table as a file stream: a folder of files, or one file in its folder."""
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith("/events.parquet"):
        stream = A.read_events(spark, batch.schema, path=sf_dir, pathGlobFilter="events.parquet")
    else:
        stream = A.read_events(spark, batch.schema, path=path)
    return stream.select("event_id", "ts", *item_columns())


def item_columns():
    return (
        (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("item_id"),
        F.col("value").cast("decimal(18,2)").alias("quantity"),
    )


def run_changes(spark, totals, keys, name, mode="update"):
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    A.write_changes(totals, path, checkpoint, mode).awaitTermination()
    return A.latest_totals(spark, path, totals.schema, keys)


SLOTS_SQL = """SELECT strftime(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS slot_start,
       CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 3 AS VARCHAR) AS item_id,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS actual_quantity, count(*) AS sales
FROM events GROUP BY 1, 2"""


@register("stream_slot_actuals", SLOTS_SQL)
def stream_slot_actuals(spark, sf_dir):
    totals = A.slot_actuals(event_stream(spark, sf_dir), ["item_id"])
    return V.tidy(run_changes(spark, totals, ["slot_start", "item_id"], "slot-actuals"))


@register("stream_dedupe", "SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS quantity FROM events")
def stream_dedupe(spark, sf_dir):
    # Every event arrives twice.
    twice = event_stream(spark, sf_dir).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    path = fresh_path(spark, "tickets")
    once = A.dedupe_tickets(twice, "event_id").select("event_id", "quantity")
    A.write_rows(once, path, fresh_path(spark, "tickets-checkpoint")).awaitTermination()
    return V.tidy(spark.read.schema(once.schema).parquet(path))


@register("stream_pos_stats", """SELECT count(*) AS total_transactions,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_items_sold,
       CAST(sum(CAST(value AS DECIMAL(18,2)) * 3) AS DOUBLE) AS total_revenue FROM events""")
def stream_pos_stats(spark, sf_dir):
    amounts = event_stream(spark, sf_dir).withColumn("amount", F.col("quantity") * 3)
    return V.tidy(run_changes(spark, A.running_stats(amounts), [], "running-stats", mode="complete"))


def event_rows(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", "ts", *item_columns())


def delivered(spark, rows, path, *, files=1, **options):
    """Keep the table at ``path`` by a stream of its own over the rows, a batch for each file."""
    folder = fresh_path(spark, "event-files")
    rows.repartition(files, F.xxhash64("event_id")).write.parquet(folder)
    stream = A.read_events(spark, rows.schema, path=folder, maxFilesPerTrigger="1")
    query = U.upsert_stream(stream, path, fresh_path(spark, "actuals-checkpoint"), ["item_id"], **options)
    query.awaitTermination()
    return query


def slots(spark, path):
    return V.tidy(U.read_totals(spark, path).select("slot_start", "item_id", "actual_quantity", "sales"))


@register("stream_upsert", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS "date",
       CAST(floor(hour(ts) / 2) AS INTEGER) + 1 AS prediction_slot,
       CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 3 AS VARCHAR) AS item_type,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS actual_quantity
FROM events GROUP BY 1, 2, 3""")
def stream_upsert(spark, sf_dir):
    """Several files out of order, a batch for each, and one batch delivered again."""
    rows, path = event_rows(spark, sf_dir), fresh_path(spark, "actuals")
    query = delivered(spark, rows, path, files=4)
    U.merge_batch(rows.filter("event_id % 2 = 0"), 0, path, ["item_id"], str(query.id))
    return V.tidy(U.read_totals(spark, path).select(
        "date", slot_of(F.col("slot_start")).alias("prediction_slot"),
        F.col("item_id").alias("item_type"), "actual_quantity"))


@register("stream_backlog", SLOTS_SQL)
def stream_backlog(spark, sf_dir):
    """Half of the events as a backlog with repeated tickets; a stream with the rest and some of the backlog."""
    rows, path = event_rows(spark, sf_dir), fresh_path(spark, "actuals")
    early = rows.filter("event_id % 2 = 0")
    U.load_backlog(early.unionAll(early), path, ["item_id"], "event_id")
    delivered(spark, rows.filter("event_id % 2 <> 0 or event_id % 3 = 0"), path, files=3, ticket="event_id")
    return slots(spark, path)


@register("stream_restart", SLOTS_SQL)
def stream_restart(spark, sf_dir):
    """A stream, another one from a new checkpoint, and a backlog after both, loaded twice: all on the same dates."""
    rows, path = event_rows(spark, sf_dir), fresh_path(spark, "actuals")
    delivered(spark, rows.filter("event_id % 3 = 0"), path, files=2)
    delivered(spark, rows.filter("event_id % 3 = 1"), path, files=2)
    for _ in range(2):
        U.load_backlog(rows.filter("event_id % 3 = 2"), path, ["item_id"])
    return slots(spark, path)


def late_tickets(spark, sf_dir):
    """The later half of the events in one batch, then the earlier ones, then every fifth ticket again."""
    rows, path = event_rows(spark, sf_dir), fresh_path(spark, "actuals")
    folder = fresh_path(spark, "event-files")
    recent = F.col("ts") >= F.lit(LATE_CUT).cast("timestamp")
    for part in (rows.filter(recent), rows.filter(~recent), rows.filter("event_id % 5 = 0")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = A.read_events(spark, rows.schema, path=folder, maxFilesPerTrigger="1")
    checkpoint = fresh_path(spark, "actuals-checkpoint")
    U.upsert_stream(stream, path, checkpoint, ["item_id"], ticket="event_id").awaitTermination()
    return path


LATE_CUT = "2024-01-16"


@register("stream_late", SLOTS_SQL)
def stream_late(spark, sf_dir):
    return slots(spark, late_tickets(spark, sf_dir))


@register("stream_late_counts", f"""WITH cut AS (
  SELECT max(ts) - INTERVAL 2 HOUR AS watermark FROM events WHERE ts >= TIMESTAMP '{LATE_CUT}')
SELECT count(*) + count(*) FILTER (event_id % 5 = 0) AS events, count(*) AS counted,
       count(*) FILTER (event_id % 5 = 0) AS repeated,
       count(*) FILTER (ts < TIMESTAMP '{LATE_CUT}' AND ts < watermark) AS late, CAST(0 AS BIGINT) AS no_time
FROM events, cut""")
def stream_late_counts(spark, sf_dir):
    return U.event_counts(spark, late_tickets(spark, sf_dir)).drop("stream_id")
