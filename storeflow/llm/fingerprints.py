"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the bytes of a text; where its low bits are zero a chunk ends,
so an edit moves the borders next to it and no others. A fingerprint is the
sequence of chunk hashes at one block size (the mean length of a chunk) and at
twice that size. Two fingerprints are compared where they have a block size in
common, by the edit distance of the sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks, work
from storeflow.llm.tables import table

CHUNKS = 64  # the block size is the smallest that gives no more on average
REPEATS = 3
LEAST = 2  # the smallest block size, as a power of two
WINDOW = 8  # bytes that decide about a border
OUT_ROWS = 2048
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODES = [a + b for a in LETTERS for b in LETTERS]  # a chunk's 12 bits
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def _rolled(data: bytes) -> np.ndarray:
    """The rolling hash at every byte: a mix of the ``WINDOW`` bytes that end there."""
    window = np.ndarray((len(data),), "<u8", bytes(WINDOW - 1) + data, strides=(1,))
    mixed = window * MIX[0]
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX[1]
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _repeats_cut(codes: list[int]) -> list[int]:
    """The codes without those that have occurred ``REPEATS`` times: a line repeated for pages adds nothing."""
    seen: dict[int, int] = {}
    kept = []
    for code in codes:
        seen[code] = seen.get(code, 0) + 1
        if seen[code] <= REPEATS:
            kept.append(code)
    return kept


def fingerprint(text: str) -> str:
    """``block size:chunks:chunks at twice that size``, two letters for each chunk; the whole text counts.

    The block size is the smallest power of two, from 4 on, that makes 64 chunks
    of a text of its length or fewer, if borders are as frequent as on average.
    Equal chunks count three times at most. An empty text has none: ``4::``.
    """
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{1 << LEAST}::"
    size = max(LEAST, (-(-len(data) // CHUNKS) - 1).bit_length())
    rolled = _rolled(data)
    borders = np.flatnonzero((rolled & np.uint64((1 << size) - 1)) == 0)
    borders = borders[borders < len(data) - 1]
    coarse = (rolled[borders] & np.uint64((2 << size) - 1)) == 0

    def chunks(ends: np.ndarray) -> str:
        sums = np.add.reduceat(rolled, np.concatenate([[0], ends + 1])) * MIX[2]
        sums ^= sums >> np.uint64(31)
        return "".join([CODES[c] for c in _repeats_cut(((sums * MIX[0]) >> np.uint64(52)).tolist())])

    return f"{1 << size}:{chunks(borders)}:{chunks(borders[coarse])}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence of chunks, a row of the table at a time in the bits of one number."""
    places: dict[str, int] = {}
    for i in range(0, len(a), 2):
        places[a[i : i + 2]] = places.get(a[i : i + 2], 0) | 1 << (i // 2)
    full = (1 << (len(a) // 2)) - 1
    row = full
    for i in range(0, len(b), 2):
        hit = row & places.get(b[i : i + 2], 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) // 2 - row.bit_count()


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for nothing in common or no common block size.

    Else 1 - d / (m + n) at the best common block size, with d the insertions
    and deletions that turn m chunks into n.
    """
    if a == b:
        return 1.0
    (size_a, one_a, two_a), (size_b, one_b, two_b) = a.split(":"), b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    pairs = []
    if size_a == size_b:
        pairs = [(one_a, one_b), (two_a, two_b)]
    elif size_a == 2 * size_b:
        pairs = [(one_a, two_b)]
    elif size_b == 2 * size_a:
        pairs = [(two_a, one_b)]
    return max((4 * _common(x, y) / (len(x) + len(y)) for x, y in pairs if x and y), default=0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; a null text counts as empty, repeated rows each have theirs.

    Equal texts have equal fingerprints. A null id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({
                "id": batch.column("id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "fingerprint": pa.array([fingerprint(t) for t in texts], pa.string()),
            })

    return blocks.narrow(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, fingerprint string")


def likenesses(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """The rows of ``pairs`` with the likeness of two columns of fingerprints; null where one is null."""
    if name in pairs.columns:
        raise ValueError(f"there is a column {name} already")
    blocks.importable(pairs.sparkSession)

    @F.pandas_udf("double")
    def compared(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn(name, compared(F.col(f"`{left}`"), F.col(f"`{right}`")))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
NAMES = [part.split()[0] for part in COMPARED.split(", ")]
TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
#: Rows of a part in order: finished ones, and the texts at its ends, which meet those of the next part.
STREAMED = f"{COMPARED}, part int, first string, last string"


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = zip(*rows)
    return pa.record_batch([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def compare(name: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    """A finished row for a text, given its fingerprint, the following text and that one's fingerprint."""
    changed = edited(text, following)
    changed_mark = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return name, len(text), digest, mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part of the documents in order; one text is held at a time."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    out: list[tuple] = []
    blank = (None,) * len(NAMES)
    for batch in batches:
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            mark = fingerprint(text)
            if held is None:
                out.append((*blank, part, text, None))
            else:
                out.append((*compare(*held, text, mark), part, None, None))
            held = (name, text, mark)
            if len(out) >= OUT_ROWS:
                yield _record(STREAMED, out)
                out = []
    if held is not None:
        out.append((held[0], *blank[1:], part, None, held[1]))
        yield _record(STREAMED, out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last text of a part with the first of the next."""
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "last", "first")))
        done = [compare(name, last, fingerprint(last), first, fingerprint(first)) for name, last, first in rows]
        if done:
            yield _record(COMPARED, done)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against the next one and against itself with its last half taken from the next one.

    Documents follow each other by id, null first, the same ids by a hash of
    their text; after the last comes the first, and a single one follows itself.
    A null text counts as empty; repeated rows each have a result.

    The order is a range exchange over all parts, so no id, however frequent,
    fills one of them. Each part is streamed; its two end texts are written and
    meet those of its neighbours, a row per part.
    """
    spark = docs.sparkSession
    order = ["id", "hash", "row"]
    rows = blocks.narrow(docs, id_col, text_col).select(
        "id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    made = work.written(ordered.mapInArrow(_streamed, STREAMED), "neighbours")
    done = made.where(F.col("fingerprint").isNotNull()).select(*NAMES)
    # The numbers of the parts come to the driver, one for each task.
    parts = sorted(r["part"] for r in made.where(F.col("first").isNotNull()).select("part").collect())
    if not parts:
        return done
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, after int")
    ends = made.where(F.col("last").isNotNull()).select("doc_id", "last", "part").join(F.broadcast(after), "part").join(
        made.where(F.col("first").isNotNull()).select(F.col("part").alias("after"), "first"), "after"
    )
    return done.unionAll(ends.select("doc_id", "last", "first").mapInArrow(_joined, COMPARED))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
SQL: dict[str, str] = {}
