"""Documents packed into blocks of bounded size.

Statistics over words or windows are shared by many documents. Sending them to
every document costs a row for each occurrence; sending them to a block costs a
row for each distinct value in it. A block is one row: its number and its
documents as compressed Arrow data.

Blocks are numbered by input partition, so the input must be read in a
repeatable way, as a scan of files is: the same partition must give the same
rows in the same order when a task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm.tables import importable

BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20  # of text whose values meet in one bucket
SCHEMA = "block long, payload binary"
_SHIFT = 24  # blocks of one input partition


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text only, under fixed names; a null text counts as empty."""
    importable(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def tables(batches: Iterator[pa.RecordBatch], max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(block number, its rows) for one input partition; a longer text is a block of its own."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << _SHIFT
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = batch.column("text").cast(pa.large_string()).buffers()[1]
        sizes = memoryview(ends).cast("q")[batch.column("text").offset:][: batch.num_rows + 1] if batch.num_rows else [0]
        start = 0
        for row in range(batch.num_rows):
            length = sizes[row + 1] - sizes[row] + 64
            if size and size + length > max_bytes:
                held.append(batch.slice(start, row - start))
                yield number, pa.Table.from_batches(held)
                number, held, size, start = number + 1, [], 0, row
            size += length
        held.append(batch.slice(start))
    if size:
        yield number, pa.Table.from_batches(held)


def payload(table: pa.Table, level: int | None = None) -> bytes:
    """The table as compressed bytes; ``level`` is zstd's, by default its fastest usual one."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd" if level is None else pa.Codec("zstd", compression_level=level))
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def buckets(spark: SparkSession) -> int:
    """Into how many parts values are dealt by their hash: as many as a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def value_buckets(rows: DataFrame) -> int:
    """Into how many buckets the values of ``rows`` (with a column text) are dealt by their hash.

    One per ``BUCKET_BYTES`` of text, so that a task's memory does not grow with
    the corpus, and at least as many as a shuffle has. A block sends a row to
    each bucket that it has values for: never more rows than distinct values.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(buckets(rows.sparkSession), -(-total // BUCKET_BYTES))


def pack(rows: DataFrame, max_bytes: int = BLOCK_BYTES, level: int | None = None) -> DataFrame:
    """One row (block, payload) per block of ``rows``, which has the columns id and text."""

    def run(batches):
        for number, table in tables(batches, max_bytes):
            yield pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([payload(table, level)], pa.binary())], names=["block", "payload"]
            )

    return rows.mapInArrow(run, SCHEMA)
