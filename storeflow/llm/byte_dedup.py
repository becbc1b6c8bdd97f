"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

All suffixes that can share a window meet in one bucket (see ``windows``). There
they are ordered by most-significant-digit passes of eight bytes, only through
the window's width; suffixes that are alone with their prefix drop out after
each pass. The groups that are left after the last pass are the repeated windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks, windows
from storeflow.llm.tables import table

WIDTH = 50
GRAM = 24


def read(docs: pa.Table) -> windows.Corpus:
    text = docs.column("text").combine_chunks().cast(pa.large_binary())
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    symbols = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and len(ends) else np.empty(0, np.uint8)
    ids = docs.column("id").fill_null(windows.NONE).to_numpy()
    return windows.Corpus(symbols, ends[1:] - ends[0], ids)


def equal_groups(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (numbers into ``starts``) that share their first ``width`` bytes with another, and their groups."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digits = np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,))
    left, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, width, 8):
        digit = digits[starts[left] + depth].astype(np.uint64)
        if width - depth < 8:
            digit >>= np.uint64(8 * (8 - (width - depth)))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        left = left[~alone]
        if not len(left):
            break
    return left, group


def solve(rows: pa.Table, task: windows.Task) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the smallest id of its content, and which of its windows occur under a smaller one."""
    content = rows.column("content").combine_chunks()
    content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    coded = content.dictionary_encode()
    code = coded.indices.to_numpy()
    unique = coded.dictionary
    least = np.full(len(unique), windows.NONE, np.int64)
    np.minimum.at(least, code, rows.column("id").to_numpy())
    n = np.zeros(len(unique), np.int64)
    n[code] = rows.column("n").to_numpy()
    anchor = np.zeros(len(unique), np.uint64)
    anchor[code] = rows.column("anchor").to_numpy()
    # Only a content that shares its anchor with another can have windows elsewhere.
    _, at, sharing = np.unique(anchor, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(sharing[at] > 1)
    mask = np.zeros(len(unique), np.uint64)
    if len(open_):
        _, offsets, data = unique.cast(pa.large_binary()).buffers()
        begin = np.frombuffer(offsets, np.int64)[: len(unique) + 1]
        many = n[open_]
        owner = np.repeat(open_, many)
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        left, group = equal_groups(np.frombuffer(data, np.uint8), begin[owner] + bit, task.width)
        if len(left):
            firsts = np.flatnonzero(np.diff(group, prepend=0))
            smallest = np.minimum.reduceat(least[owner[left]], firsts)
            sizes = np.diff(np.append(firsts, len(left)))
            hit = np.repeat(smallest, sizes) < least[owner[left]]
            np.bitwise_or.at(mask, owner[left][hit], np.uint64(1) << bit[left][hit].astype(np.uint64))
    return least[code], mask[code]


def finish(docs: pa.Table, corpus: windows.Corpus, gone: np.ndarray) -> pa.Table:
    starts = np.concatenate([[0], corpus.ends[:-1]]) if len(corpus.ends) else np.empty(0, np.int64)
    spans, kept = [], []
    for start, end in zip(starts.tolist(), corpus.ends.tolist()):
        mine = gone[start:end]
        edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).reshape(-1, 2)
        spans.append([{"start": a, "stop": b} for a, b in edges.tolist()])
        kept.append(corpus.symbols[start:end][~mine].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({
        "id": docs.column("id"), "n_bytes": pa.array(corpus.ends - starts, pa.int64()),
        "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()),
    })


def without_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    max_bytes: int = windows.BLOCK_BYTES,
) -> DataFrame:
    """``id_col``, n_bytes, spans array<struct<start, stop>>, kept binary for every row.

    Texts are UTF-8 bytes. A byte is removed if it lies in a string of ``width``
    bytes (34 at least) that also starts in a document with a smaller id; strings
    are judged on the input. What is kept need not be valid UTF-8.

    A null or empty text has no bytes. A null id is larger than any other; rows
    with equal or null ids take nothing from one another. Other columns are
    ignored.
    """
    gram = max(min(GRAM, (width - 10) // 8 * 8), -(-(width - 63) // 8) * 8)  # 64 windows of one anchor at most
    rows = blocks.narrow(docs, id_col, text_col)
    task = windows.Task(width, gram, read, windows.byte_grams, solve, blocks.value_buckets(rows))
    schema = "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    return windows.search(rows, task, finish, schema, max_bytes).withColumnRenamed("id", id_col)


def op7_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op7_byte_dedup": op7_byte_dedup}
SQL: dict[str, str] = {}
