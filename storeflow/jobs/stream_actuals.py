"""Keep the actual units per two-hour slot up to date from POS events.

    spark-submit storeflow/jobs/stream_actuals.py --source kafka \\
        --option kafka.bootstrap.servers=host:9092 --option subscribe=pos \\
        --output s3a://bucket/actuals --checkpoint s3a://bucket/checkpoints/actuals
"""

from __future__ import annotations

import argparse

from pyspark.sql import types as T

from storeflow.session import STREAM_SETTINGS, job_session
from storeflow.streaming.actuals import LATENESS, read_events
from storeflow.streaming.upserts import event_counts, load_backlog, upsert_stream

EVENT = T.StructType([
    T.StructField("ss_ticket_number", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("item_subtype", T.StringType()),
    T.StructField("quantity", T.DecimalType(18, 2)),
])


def main() -> None:
    parser = argparse.ArgumentParser(description="actual units per slot from POS events")
    parser.add_argument("--source", default="kafka")
    parser.add_argument("--option", action="append", default=[], help="key=value for the source")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--lateness", default=LATENESS, help="events behind the latest by more than this are listed as late; they count all the same")
    parser.add_argument("--backlog", help="parquet folder of older events, added as one batch before the stream; again: no change")
    parser.add_argument("--once", action="store_true", help="process what is there and stop")
    args = parser.parse_args()
    spark = job_session("stream-actuals", STREAM_SETTINGS)
    keys = ["item_type", "item_subtype"]
    if args.backlog:
        load_backlog(spark.read.schema(EVENT).parquet(args.backlog), args.output, keys, "ss_ticket_number")
    options = dict(o.split("=", 1) for o in args.option)
    events = read_events(spark, EVENT, args.source, **options)
    query = upsert_stream(events, args.output, args.checkpoint, keys, args.once, "ss_ticket_number", args.lateness)
    query.awaitTermination()
    event_counts(spark, args.output).show(truncate=False)


if __name__ == "__main__":
    main()
