"""Exact search for repeated windows of a fixed width over a corpus.

Two equal windows have the same anchor: the run of ``gram`` symbols inside them
with the least hash. Windows that follow one another and share an anchor form a
segment, so about one window in ten has to be looked at.

1. Every block sends the hashes of its anchors; anchors that occur once in the
   corpus are done with, as their windows occur once.
2. Every block sends its distinct segments at the other anchors, dealt by
   anchor, so that all windows that can be equal meet in one bucket, where
   ``solve`` finds the equal ones.
3. The findings go back to the blocks, which mark their texts.

Segments are kept once per block and again once per bucket: a passage that
occurs in a third of all documents costs one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeflow.llm import blocks

PIECE = 1 << 20  # window starts handled at once
PLACE = np.uint64(21)  # bits of a place inside a piece
FILTER_BITS = np.uint64(24)  # of an anchor's hash that are not sent in the first step
BLOCK_BYTES = 8 << 20
NONE = np.iinfo(np.int64).max  # stands for a null id: no id is larger


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_grams(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes, a multiple of 8."""
    n = len(symbols) - gram + 1
    words = np.ndarray((len(symbols) - 7,), "<u8", np.ascontiguousarray(symbols).data, strides=(1,))
    out = np.full(n, gram, np.uint64)
    for at in range(0, gram, 8):
        out = mixed(out + words[at : at + n])
    return out


def word_grams(symbols: np.ndarray, gram: int) -> np.ndarray:
    n = len(symbols) - gram + 1
    out = np.full(n, gram, np.uint64)
    for at in range(gram):
        out = (out ^ symbols[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mixed(out)


@dataclass
class Corpus:
    """The documents of a block, one after another."""

    symbols: np.ndarray
    ends: np.ndarray  # of each document
    ids: np.ndarray  # NONE for null


@dataclass
class Segments:
    """Runs of windows with one anchor, in order of their place."""

    first: np.ndarray  # the first window's start in the block
    n: np.ndarray  # windows
    at: np.ndarray  # the anchor's place after ``first``
    anchor: np.ndarray  # its hash


def segments(corpus: Corpus, width: int, gram: int, grams: Callable) -> Segments:
    found = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
    total = len(corpus.symbols) - width + 1
    span = width - gram + 1
    low = (np.uint64(1) << PLACE) - np.uint64(1)
    for start in range(0, max(total, 0), PIECE):
        count = min(PIECE, total - start)
        hashes = grams(corpus.symbols[start : start + count + width - 1], gram)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        length = 1
        while length * 2 <= span:
            least = np.minimum(least[: len(least) - length], least[length:])
            length *= 2
        rest = span - length
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        place = (least[:count] & low).astype(np.int64)
        # A window must lie inside a document.
        inside = np.ones(count, bool)
        docs = np.searchsorted(corpus.ends, [start, start + count + width], "right")
        for end in corpus.ends[docs[0] : docs[1] + 1]:
            inside[max(0, end - width + 1 - start) : max(0, end - start)] = False
        change = np.empty(count, bool)
        change[0] = True
        change[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
        firsts = np.flatnonzero(change)
        n = np.diff(np.append(firsts, count))
        use = inside[firsts]
        firsts, n = firsts[use], n[use]
        at = place[firsts]
        found.append((firsts + start, n, at - firsts, hashes[at]))
    return Segments(*(np.concatenate(parts) for parts in zip(*found)))


def _keys(anchor: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, shortened hash) of anchors."""
    return (anchor % np.uint64(n_buckets)).astype(np.int64), anchor >> FILTER_BITS


def squeezed(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte planes apart."""
    steps = np.diff(values, prepend=values[:1])
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return values[:1].tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def spread(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).reshape(n)
    return np.cumsum(steps, dtype=np.uint64) + np.frombuffer(data[:8], np.uint64)


@dataclass
class Anchors:
    """The distinct (bucket, shortened hash) of a block in order, and which of them each segment has."""

    bucket: np.ndarray
    value: np.ndarray
    several: np.ndarray
    of_segment: np.ndarray

    def slices(self) -> Iterator[tuple[int, slice]]:
        starts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for start, stop in zip(starts, np.append(starts[1:], len(self.bucket))):
            yield int(self.bucket[start]), slice(start, stop)


def anchors(found: Segments, n_buckets: int) -> Anchors:
    bucket, value = _keys(found.anchor, n_buckets)
    order = np.lexsort((value, bucket))
    new = np.ones(len(order), bool)
    new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (value[order][1:] != value[order][:-1])
    starts = np.flatnonzero(new)
    of_segment = np.empty(len(order), np.int64)
    of_segment[order] = np.cumsum(new) - 1
    counts = np.diff(np.append(starts, len(order)))
    return Anchors(bucket[order][starts], value[order][starts], counts > 1, of_segment)


@dataclass
class Task:
    """What a search is made of; symbols of a block's texts, and the solution inside a bucket."""

    width: int
    gram: int
    read: Callable[[pa.Table], Corpus]
    grams: Callable[[np.ndarray, int], np.ndarray]
    solve: Callable[[pa.Table, "Task"], tuple[np.ndarray, np.ndarray]]
    n_buckets: int

    def segments(self, corpus: Corpus) -> Segments:
        return segments(corpus, self.width, self.gram, self.grams)


def _batch(**columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _sent_anchors(task: Task, max_bytes: int):
    def run(batches):
        for number, table in blocks.tables(batches, max_bytes):
            mine = anchors(task.segments(task.read(table)), task.n_buckets)
            for bucket, part in mine.slices():
                yield _batch(
                    bucket=([bucket], pa.int32()), block=([number], pa.int64()),
                    n=([part.stop - part.start], pa.int32()),
                    data=([squeezed(mine.value[part])], pa.binary()),
                    several=([np.packbits(mine.several[part]).tobytes()], pa.binary()),
                )

    return run


def _met_anchors(rows: pa.Table) -> pa.Table:
    """For each block a bit for each of its anchors: whether it occurs again anywhere."""
    sizes = rows.column("n").to_pylist()
    values = np.concatenate([spread(d.as_py(), n) for d, n in zip(rows.column("data"), sizes)])
    several = np.concatenate(
        [np.unpackbits(np.frombuffer(d.as_py(), np.uint8), count=n) for d, n in zip(rows.column("several"), sizes)]
    )
    order = np.argsort(values, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = values[order][1:] == values[order][:-1]
    again = same.copy()
    again[:-1] |= same[1:]
    several = several.astype(bool)
    several[order] |= again
    # A value that is repeated in one block counts in no other: then it occurs twice there anyway.
    parts = np.split(several, np.cumsum(sizes)[:-1])
    return pa.table(
        {"block": rows.column("block"), "kind": pa.array([0] * len(sizes), pa.int32()), "bucket": rows.column("bucket"),
         "data": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())}
    )


def _chosen(task: Task, corpus: Corpus, found: Segments, bits: dict[int, bytes]) -> np.ndarray:
    """The numbers of the segments whose anchor occurs again."""
    mine = anchors(found, task.n_buckets)
    flags = np.zeros(len(mine.bucket), bool)
    for bucket, part in mine.slices():
        n = part.stop - part.start
        flags[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=n)
    return np.flatnonzero(flags[mine.of_segment])


@dataclass
class Distinct:
    """The distinct segments of a block, in order of bucket and first place."""

    of_segment: np.ndarray  # for each chosen segment
    table: pa.Table  # anchor, at, n, id (smallest), count, content
    bucket: np.ndarray


def _distinct(task: Task, corpus: Corpus, found: Segments, chosen: np.ndarray) -> Distinct:
    data = corpus.symbols.tobytes()
    item = corpus.symbols.itemsize
    first, n = found.first[chosen], found.n[chosen]
    low, high = (first * item).tolist(), ((first + n + task.width - 1) * item).tolist()
    numbers: dict[tuple[int, bytes], int] = {}
    place = found.at[chosen].tolist()
    codes = np.fromiter(
        (numbers.setdefault((p, data[a:b]), len(numbers)) for p, a, b in zip(place, low, high)), np.int64, len(low)
    )
    n_distinct = len(numbers)
    start = np.full(n_distinct, len(codes), np.int64)
    np.minimum.at(start, codes, np.arange(len(codes)))
    docs = np.searchsorted(corpus.ends, first, "right")
    least = np.full(n_distinct, NONE, np.int64)
    np.minimum.at(least, codes, corpus.ids[docs] if len(docs) else np.empty(0, np.int64))
    anchor = found.anchor[chosen][start]
    bucket = (anchor % np.uint64(task.n_buckets)).astype(np.int64)
    order = np.lexsort((start, anchor, bucket))
    back = np.empty(n_distinct, np.int64)
    back[order] = np.arange(n_distinct)
    contents = [content for _, content in numbers]
    table = pa.table({
        "anchor": pa.array(anchor[order], pa.uint64()),
        "at": pa.array(found.at[chosen][start][order], pa.int16()),
        "n": pa.array(n[start][order], pa.int16()),
        "id": pa.array(least[order], pa.int64()),
        "count": pa.array(np.bincount(codes, minlength=n_distinct)[order], pa.int64()),
        "content": pa.array([contents[i] for i in order.tolist()], pa.binary()),
    })
    return Distinct(back[codes], table, bucket[order])


def _right(right: pa.Table, kind: int) -> dict[int, bytes]:
    return {
        bucket: data for k, bucket, data in
        zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("data").to_pylist())
        if k == kind
    }


def _sent_segments(task: Task):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        corpus = task.read(blocks.unpack(left.column("payload")[0].as_py()))
        found = task.segments(corpus)
        mine = _distinct(task, corpus, found, _chosen(task, corpus, found, _right(right, 0)))
        starts = np.flatnonzero(np.diff(mine.bucket, prepend=-1))
        stops = np.append(starts[1:], len(mine.bucket))
        return pa.table({
            "bucket": pa.array(mine.bucket[starts], pa.int32()),
            "block": pa.array([left.column("block")[0].as_py()] * len(starts), pa.int64()),
            "data": pa.array(
                [blocks.payload(mine.table.slice(a, b - a)) for a, b in zip(starts, stops)], pa.binary()
            ),
        })

    return run


def _solved(task: Task):
    def run(rows: pa.Table) -> pa.Table:
        parts = [blocks.unpack(d.as_py()) for d in rows.column("data")]
        sizes = [p.num_rows for p in parts]
        least, mask = task.solve(pa.concat_tables(parts), task)
        out, at = [], 0
        for n in sizes:
            answer = pa.table({"least": least[at : at + n], "mask": mask[at : at + n]})
            out.append(blocks.payload(answer))
            at += n
        return pa.table({
            "block": rows.column("block"), "kind": pa.array([1] * len(out), pa.int32()),
            "bucket": rows.column("bucket"), "data": pa.array(out, pa.binary()),
        })

    return run


def covered(task: Task, corpus: Corpus, right: pa.Table) -> np.ndarray:
    """Which symbols of the block lie in a window to remove."""
    found = task.segments(corpus)
    chosen = _chosen(task, corpus, found, _right(right, 0))
    mine = _distinct(task, corpus, found, chosen)
    answers = _right(right, 1)
    marks = np.zeros(len(corpus.symbols) + 1, np.int32)
    if len(chosen):
        answer = pa.concat_tables([blocks.unpack(answers[b]) for b in sorted(answers)])
        if answer.num_rows != mine.table.num_rows:
            raise ValueError("the segments of a block differ between two reads of its input")
        least = answer.column("least").to_numpy()[mine.of_segment]
        mask = answer.column("mask").to_numpy()[mine.of_segment]
        first, n = found.first[chosen], found.n[chosen]
        own = corpus.ids[np.searchsorted(corpus.ends, first, "right")]
        whole = own > least
        np.add.at(marks, first[whole], 1)
        np.add.at(marks, (first + n + task.width - 1)[whole], -1)
        for bit in range(task.width - task.gram + 1):
            hit = ~whole & (bit < n) & ((mask >> np.uint64(bit)) & np.uint64(1)).astype(bool)
            np.add.at(marks, first[hit] + bit, 1)
            np.add.at(marks, first[hit] + bit + task.width, -1)
    return np.cumsum(marks[:-1]) > 0


def search(
    rows: DataFrame, task: Task, finish: Callable[[pa.Table, Corpus, np.ndarray], pa.Table], schema: str,
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``finish`` (documents, corpus, covered symbols) of every block of ``rows`` (id, text)."""
    packed = blocks.pack(rows, max_bytes)
    sent = rows.mapInArrow(
        _sent_anchors(task, max_bytes), "bucket int, block long, n int, data binary, several binary"
    )
    back = "block long, kind int, bucket int, data binary"
    met = sent.groupBy("bucket").applyInArrow(_met_anchors, back)
    passed = packed.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(
        _sent_segments(task), "bucket int, block long, data binary"
    )
    solved = passed.groupBy("bucket").applyInArrow(_solved(task), back)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = blocks.unpack(left.column("payload")[0].as_py())
        corpus = task.read(docs)
        return finish(docs, corpus, covered(task, corpus, right))

    return packed.groupBy("block").cogroup(met.unionAll(solved).groupBy("block")).applyInArrow(last, schema)
