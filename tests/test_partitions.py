"""Dates as literals, merged states and packed files."""

import datetime as dt

from pyspark.sql import functions as F

from storeflow.sources import partitions as P


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_runs_of_days():
    assert P.date_ranges([]) == []
    assert P.date_ranges([day(3), day(1), day(2), day(9)]) == [(day(1), day(3)), (day(9), day(9))]
    # The smallest gaps are joined first.
    assert P.date_ranges([day(0), day(2), day(9), day(30)], 2) == [(day(0), day(9)), (day(30), day(30))]
    assert P.date_ranges([day(n * 2) for n in range(1000)], 1) == [(day(0), day(1998))]


def table(spark, path, days):
    rows = [(n, f"k{n % 3}", day(n % days)) for n in range(days * 6)]
    frame = spark.createDataFrame(rows, "v long, k string, date date")
    P.write_dates(frame, path)
    return frame


def test_many_single_dates_are_exact(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = table(spark, path, 500)
    wanted = [day(n) for n in range(0, 500, 2)]  # more runs than literals
    got = P.read_dates(spark, path, frame.schema, wanted)
    assert got.count() == 250 * 6 and got.where(~F.col("date").isin(wanted)).isEmpty()
    assert P.read_dates(spark, path, frame.schema, []).isEmpty()
    assert P.read_dates(spark, str(tmp_path / "none"), frame.schema, wanted).isEmpty()


def test_merge_replaces_touched_dates_only(spark, tmp_path):
    path, staged = str(tmp_path / "t"), str(tmp_path / "staged")
    frame = table(spark, path, 5)
    add = lambda rows: rows.groupBy("k", "date").agg(F.sum("v").alias("v")).select("v", "k", "date")
    new = spark.createDataFrame([(1000, "k0", day(2)), (1, "new", day(7))], frame.schema)
    assert P.merge_dates(new, path, staged, add) == [day(2), day(7)]
    for _ in range(2):  # putting it in place again changes nothing
        P.publish(spark, staged, path, frame.schema)
    expected = frame.where(F.col("date") != day(2)).unionAll(add(frame.where(F.col("date") == day(2)).unionAll(new)))
    got = spark.read.schema(frame.schema).parquet(path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_small_files_are_packed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    small = rows.withColumn("date", F.lit(day(0))).repartition(200)
    other = rows.limit(10).withColumn("date", F.lit(day(1))).coalesce(1)
    for part in (small, other):
        part.write.mode("append").partitionBy("date").parquet(path)
    before = sorted(map(tuple, spark.read.parquet(path).agg(F.count("*"), F.sum("id"), F.max("h")).collect()))
    size = P.partition_files(spark, path).agg(F.sum("length")).first()[0]
    target = size // 5
    report = P.compact(spark, path, target_bytes=target)
    row = report.first()
    assert report.count() == 1 and (row.date, row.files) == (day(0), 200) and 4 <= row.files_after <= 8
    lengths = [r.length for r in P.partition_files(spark, path).where(F.col("date") == day(0)).collect()]
    assert len(lengths) == row.files_after and sum(x >= target // 2 for x in lengths) >= len(lengths) - 1
    assert max(lengths) <= target * 1.3
    assert sorted(map(tuple, spark.read.parquet(path).agg(F.count("*"), F.sum("id"), F.max("h")).collect())) == before
    assert P.compact(spark, path, target_bytes=target).isEmpty()
    assert not list(tmp_path.glob("t-packed*"))
