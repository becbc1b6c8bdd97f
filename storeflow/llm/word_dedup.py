"""Removal of repeated runs of words with FM-indexes.

All runs that can be equal meet in one shard (see ``windows``). A shard indexes
its distinct segments and streams them through the index: backward search gives
how far each run occurs again, and the windows at or above the threshold are
reported. The index holds the segments of a bounded number of words at a time;
segments with the same anchor stay together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks, windows
from storeflow.llm.fm_index import FMIndex, repeated_windows
from storeflow.llm.tables import table

WIDTH = 35
GRAM = 8
SHARD_WORDS = 1 << 20


def words(text: pa.Scalar) -> list[bytes]:
    """Runs without white space; for bytes that is the space and 0x09 to 0x0D."""
    return text.as_buffer().to_pybytes().split()


def read(docs: pa.Table) -> windows.Corpus:
    """Words as 64-bit hashes, each distinct word hashed once."""
    texts = docs.column("text").cast(pa.large_string()).combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    lists = pc.ascii_split_whitespace(texts)
    found = lists.flatten()
    # White space at either end of a text gives an empty string there.
    real = pc.binary_length(found).to_numpy() > 0
    coded = found.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64)
    symbols = hashes[coded.indices.to_numpy()][real]
    ends = np.append(0, np.cumsum(real))[lists.offsets.to_numpy()[1:]].astype(np.int64)
    return windows.Corpus(symbols, ends, docs.column("id").fill_null(windows.NONE).to_numpy())


def solve(rows: pa.Table, task: windows.Task) -> tuple[np.ndarray, np.ndarray]:
    """For each segment which of its windows occur anywhere else."""
    content = rows.column("content").combine_chunks()
    content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    coded = content.dictionary_encode()
    code, unique = coded.indices.to_numpy(), coded.dictionary
    count = np.zeros(len(unique), np.int64)
    np.add.at(count, code, rows.column("count").to_numpy())
    anchor = np.zeros(len(unique), np.uint64)
    anchor[code] = rows.column("anchor").to_numpy()
    mask = np.where(count > 1, ~np.uint64(0), np.uint64(0))  # a segment that occurs twice
    _, offsets, data = unique.cast(pa.large_binary()).buffers()
    begin = np.frombuffer(offsets, np.int64)[: len(unique) + 1] // 8
    symbols = np.frombuffer(data, np.uint64)[: begin[-1]]
    # The others are looked for among the segments with their anchor.
    order = np.argsort(anchor, kind="stable")
    group = np.cumsum(np.append(False, anchor[order][1:] != anchor[order][:-1]))
    alone = np.bincount(group, minlength=1)[group] == 1
    settled = np.bincount(group, weights=count[order] == 1, minlength=1)[group] == 0
    order, group = order[~(alone | settled)], group[~(alone | settled)]
    sizes = (begin[1:] - begin[:-1])[order]
    at = 0
    while at < len(order):
        full = int(np.searchsorted(np.cumsum(sizes[at:]), SHARD_WORDS, "right"))
        stop = int(np.searchsorted(group, group[min(at + full, len(order) - 1)], "left")) if at + full < len(order) else len(order)
        if stop <= at:  # one anchor with more words than a shard
            stop = int(np.searchsorted(group, group[at], "right"))
        shard = order[at:stop]
        many = sizes[at:stop]
        ends = np.cumsum(many)
        places = np.repeat(begin[shard] - (ends - many), many) + np.arange(ends[-1])
        index = FMIndex(symbols[places], ends, 2 * task.width - task.gram + 1)
        ask = np.flatnonzero(count[shard] == 1)
        first = (ends - many + np.arange(len(shard)))[ask]
        mask[shard[ask]] = repeated_windows(index, first, first + many[ask], task.width)
        at = stop
    never = np.full(len(code), windows.NONE, np.int64)
    return never, mask[code]


def finish(docs: pa.Table, corpus: windows.Corpus, gone: np.ndarray) -> pa.Table:
    starts = np.concatenate([[0], corpus.ends[:-1]]) if len(corpus.ends) else np.empty(0, np.int64)
    spans, kept = [], []
    for text, start, end in zip(docs.column("text"), starts.tolist(), corpus.ends.tolist()):
        mine = gone[start:end]
        edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).reshape(-1, 2)
        spans.append([{"start": a, "stop": b} for a, b in edges.tolist()])
        found = words(text)
        kept.append(b" ".join(found if not len(edges) else [found[i] for i in np.flatnonzero(~mine).tolist()]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({
        "id": docs.column("id"), "n_words": pa.array(corpus.ends - starts, pa.int64()),
        "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def without_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    max_bytes: int = windows.BLOCK_BYTES,
) -> DataFrame:
    """``id_col``, n_words, spans array<struct<start, stop>>, kept for every row of ``docs``.

    Words are runs without white space, unchanged. A word is removed if a run of
    ``width`` words (10 to 71) covers it whose words also start anywhere else, in
    the same document or another; runs are judged on the input. Kept words are
    joined by one space.

    A null, empty or blank text has no words. Ids play no part: null and repeated
    ids are separate documents. Other columns are ignored.
    """
    gram = max(min(GRAM, width - 2), width - 63)
    rows = blocks.narrow(docs, id_col, text_col)
    task = windows.Task(width, gram, read, windows.word_grams, solve, blocks.value_buckets(rows))
    schema = "id long, n_words long, spans array<struct<start: long, stop: long>>, kept string"
    return windows.search(rows, task, finish, schema, max_bytes).withColumnRenamed("id", id_col)


def op8_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_words(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op8_word_dedup": op8_word_dedup}
SQL: dict[str, str] = {}
