import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeflow.streaming import actuals as A

EVENT = T.StructType([
    T.StructField("ticket", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("item", T.StringType()),
    T.StructField("quantity", T.DecimalType(18, 2)),
    T.StructField("amount", T.DecimalType(18, 2)),
])


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def deliver(spark, folder, *rows):
    """One more file of events."""
    events = [(t, ts, item, Decimal(q), Decimal(2 * q)) for t, ts, item, q in rows]
    spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def current(spark, folder, out, checkpoint):
    totals = A.slot_actuals(A.read_events(spark, EVENT, path=str(folder)), ["item"])
    A.write_changes(totals, str(out), str(checkpoint)).awaitTermination()
    rows = A.latest_totals(spark, str(out), totals.schema, ["slot_start", "item"]).collect()
    return {(r.slot_start.hour, r.item): int(r.actual_quantity) for r in rows}


def test_totals_move_with_new_events_and_late_ones_are_dropped(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    deliver(spark, folder, (1, at(1), "a", 5), (2, at(1, 59), "a", 1), (3, at(2), "a", 7), (4, at(1), "b", 2))
    assert current(spark, folder, out, state) == {(0, "a"): 6, (2, "a"): 7, (0, "b"): 2}
    deliver(spark, folder, (5, at(3), "a", 1), (6, at(9), "a", 4))
    assert current(spark, folder, out, state) == {(0, "a"): 6, (2, "a"): 8, (0, "b"): 2, (8, "a"): 4}
    deliver(spark, folder, (7, at(1), "a", 100), (8, at(8), "a", 1))
    assert current(spark, folder, out, state) == {(0, "a"): 6, (2, "a"): 8, (0, "b"): 2, (8, "a"): 5}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    for batch, value in ((0, 1), (1, 5), (1, 5)):
        rows = spark.createDataFrame([("a", value)], schema)
        rows.write.mode("overwrite").parquet(f"{tmp_path}/batch_id={batch}")
    assert [tuple(r) for r in A.latest_totals(spark, str(tmp_path), schema, ["k"]).collect()] == [("a", 5)]


def test_tickets_count_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"

    def run():
        once = A.dedupe_tickets(A.read_events(spark, EVENT, path=str(folder)), "ticket")
        A.write_rows(once.select("ticket", "quantity"), str(out), str(state)).awaitTermination()
        return sorted(r.ticket for r in spark.read.parquet(str(out)).collect())

    deliver(spark, folder, (1, at(1), "a", 5), (1, at(1), "a", 5), (2, at(1), "a", 5))
    assert run() == [1, 2]
    deliver(spark, folder, (2, at(1, 30), "a", 5), (3, at(1, 40), "a", 5))
    assert run() == [1, 2, 3]


def test_running_stats(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    for rows, expected in (([(1, at(1), "a", 5)], (1, 5, 10)), ([(2, at(2), "b", 3), (3, at(0), "b", 1)], (3, 9, 18))):
        deliver(spark, folder, *rows)
        stats = A.running_stats(A.read_events(spark, EVENT, path=str(folder)))
        A.write_changes(stats, str(out), str(state), mode="complete").awaitTermination()
        row = A.latest_totals(spark, str(out), stats.schema, []).first()
        assert (row.total_transactions, row.total_items_sold, row.total_revenue) == expected


def test_deduplicated_tickets_feed_the_slot_totals(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    deliver(spark, folder, (1, at(1), "a", 5), (1, at(1), "a", 5), (2, at(1), "a", 2))
    events = A.dedupe_tickets(A.read_events(spark, EVENT, path=str(folder)), "ticket")
    totals = A.slot_totals_of(events, ["item"])
    A.write_changes(totals, str(out), str(state)).awaitTermination()
    assert A.latest_totals(spark, str(out), totals.schema, ["slot_start", "item"]).first().actual_quantity == 7


def test_stream_equals_batch(spark, tmp_path):
    rows = [(n, at(n % 20, n % 60), "ab"[n % 2], n) for n in range(200)]
    deliver(spark, tmp_path / "in", *rows)
    got = current(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state")
    batch = spark.read.schema(EVENT).parquet(str(tmp_path / "in"))
    slot = F.floor(F.hour("ts") / 2) * 2
    expected = batch.groupBy(slot.alias("s"), "item").agg(F.sum("quantity").alias("q")).collect()
    assert got == {(r.s, r.item): int(r.q) for r in expected}
