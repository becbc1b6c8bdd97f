"""Scores of texts under a word bigram model with deleted interpolation.

The probability of a word is a mixture of maximum-likelihood estimates: of the
bigram, of the single word, and an even one over the vocabulary. The weights
depend on how often the context occurs (one set for each power of two) and are
learned by expectation-maximisation on documents deleted from the counts.

Counts are exact and cover all training documents. Every block of documents
sends its distinct n-grams, as 64-bit hashes with their counts, to a bucket by
hash; the bucket adds them up and sends each block the totals of its own
n-grams. What moves is a number per distinct n-gram of a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks, work
from storeflow.llm.quality import held_out
from storeflow.llm.tables import table
from storeflow.llm.windows import spread, squeezed, mixed

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# No word holds a space.
END, START = np.uint64(xxhash.xxh3_64_intdigest(b" end")), np.uint64(xxhash.xxh3_64_intdigest(b" start"))
COUNTED, DELETED, OTHER = 0, 1, 2  # parts of the documents
CLASSES = 40  # of context counts
STEPS = 4  # of a log2 of a probability in the histogram that the weights are learned from
ZERO = 255
ROUNDS = 100
FLOOR = 1e-6


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@dataclass
class Block:
    """The tokens of a block and its distinct n-grams."""

    ends: np.ndarray  # of each document, in tokens
    part: np.ndarray  # of each document
    keys: dict[int, np.ndarray]  # by order: distinct hashes in order
    at: dict[int, np.ndarray]  # by order: the number of each token's n-gram among them

    def counts(self, order: int, part: int) -> np.ndarray:
        use = np.repeat(self.part == part, np.diff(self.ends, prepend=0))
        return np.bincount(self.at[order][use], minlength=len(self.keys[order]))


def read(docs: pa.Table) -> Block:
    hashes = Hashes()
    parts = []
    for text in docs.column("text"):
        found = WORD.findall(text.as_buffer().to_pybytes().lower())
        parts.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
        parts.append(np.array([END]))
    tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    ends = np.cumsum([len(a) + 1 for a in parts[::2]]).astype(np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.append(0, ends[:-1])[: len(ends)]] = START
    keys, at = {}, {}
    keys[1], at[1] = np.unique(tokens, return_inverse=True)
    keys[2], at[2] = np.unique(mixed(mixed(before) + tokens), return_inverse=True)
    return Block(ends, docs.column("part").to_numpy(), keys, at)


def _blocks(batches, max_bytes: int):
    """Blocks of deleted documents have odd numbers, all others even ones."""
    for number, docs in blocks.tables(batches, max_bytes):
        part = docs.column("part").to_numpy()
        for odd in (0, 1):
            rows = np.flatnonzero((part == DELETED) == bool(odd))
            if len(rows):
                yield 2 * number + odd, docs.take(pa.array(rows))


def _dealt(keys: np.ndarray, n_buckets: int):
    """(bucket, the numbers of its keys) in order."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, stop in zip(starts, np.append(starts[1:], len(order))):
        yield int(bucket[order[start]]), order[start:stop]


def _small(counts: np.ndarray) -> bytes:
    """Counts as eight planes of bytes; the upper ones are nearly always 0 and compress away."""
    return pa.compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _large(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(n).astype(np.int64)


def _packed(max_bytes: int):
    def run(batches):
        for number, docs in _blocks(batches, max_bytes):
            yield pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([blocks.payload(docs)], pa.binary())], names=["block", "payload"]
            )

    return run


def _sent(n_buckets: int, max_bytes: int):
    def run(batches):
        for number, docs in _blocks(batches, max_bytes):
            block = read(docs)
            for order, keys in block.keys.items():
                counted, deleted = block.counts(order, COUNTED), block.counts(order, DELETED)
                for bucket, mine in _dealt(keys, n_buckets):
                    row = {
                        "bucket": pa.array([2 * bucket + order - 1], pa.int32()),
                        "block": pa.array([number], pa.int64()),
                        "n": pa.array([len(mine)], pa.int32()),
                        "keys": pa.array([squeezed(keys[mine])], pa.binary()),
                        "counted": pa.array([_small(counted[mine])], pa.binary()),
                        "deleted": pa.array([_small(deleted[mine])], pa.binary()),
                    }
                    yield pa.RecordBatch.from_pydict(row)

    return run


def _added(rows: pa.Table) -> pa.Table:
    """Totals of a bucket's n-grams for every block that has them, and how many n-grams there are."""
    sizes = rows.column("n").to_pylist()
    keys = np.concatenate([spread(k.as_py(), n) for k, n in zip(rows.column("keys"), sizes)])
    distinct, code = np.unique(keys, return_inverse=True)
    total = []
    for name in ("counted", "deleted"):
        counts = np.concatenate([_large(c.as_py(), n) for c, n in zip(rows.column(name), sizes)])
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, code, counts)
        total.append(sums)
    counted, both = total[0], total[0] + total[1]
    cuts = np.cumsum(sizes)[:-1]
    first = np.zeros(len(sizes), np.int64)
    stats = {}
    for name, value in (("n_counted", counted.sum()), ("n_both", both.sum()), ("v_counted", (counted > 0).sum()), ("v_both", (both > 0).sum())):
        stats[name] = pa.array(np.where(np.arange(len(sizes)) == 0, int(value), first), pa.int64())
    return pa.table({
        "block": rows.column("block"), "bucket": rows.column("bucket"),
        "counted": pa.array([_small(c) for c in np.split(counted[code], cuts)], pa.binary()),
        "both": pa.array([_small(c) for c in np.split(both[code], cuts)], pa.binary()),
        **stats,
    })


TOTALS = "block long, bucket int, counted binary, both binary, n_counted long, n_both long, v_counted long, v_both long"


def _counts(block: Block, right: pa.Table, column: str, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token the counts of its bigram, of its context and of itself."""
    data = dict(zip(right.column("bucket").to_pylist(), right.column(column).to_pylist()))
    by_order = {}
    for order, keys in block.keys.items():
        totals = np.zeros(len(keys), np.int64)
        for bucket, mine in _dealt(keys, n_buckets):
            totals[mine] = _large(data[2 * bucket + order - 1], len(mine))
        by_order[order] = totals[block.at[order]]
    single = by_order[1]
    context = np.empty_like(single)
    context[1:] = single[:-1]
    # A text starts as often as one ends.
    context[np.append(0, block.ends[:-1])[: len(block.ends)]] = single[block.ends - 1]
    return by_order[2], context, single


def _classes(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)), CLASSES - 1).astype(np.int64)


def _share(part: np.ndarray, whole) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=np.broadcast_to(np.asarray(whole) > 0, part.shape))


def _histogram(total: int, n_buckets: int):
    """How often each (class, bigram estimate, word estimate) occurs in the deleted documents of a block."""

    def step(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.minimum(np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS), ZERO - 1), ZERO).astype(np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = read(blocks.unpack(left.column("payload")[0].as_py()))
        pair, context, single = _counts(block, right, "counted", n_buckets)
        code = (_classes(context) * 256 + step(_share(pair, context))) * 256 + step(_share(single, total))
        values, n = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(values, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def weights(code: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixture weights (bigram, word, even) of every class, by expectation-maximisation on the histogram."""
    out = np.full((CLASSES, 3), 1 / 3)
    value = lambda step: np.where(step == ZERO, 0.0, 2.0 ** (-step / STEPS))
    p = np.stack([value(code // 256 % 256), value(code % 256), np.full(len(code), 1 / (vocabulary + 1))], 1)
    for number in np.unique(code // 65536):
        mine = code // 65536 == number
        mix = out[number]
        for _ in range(ROUNDS):
            each = p[mine] * mix
            each /= each.sum(1, keepdims=True)
            new = (each * n[mine][:, None]).sum(0) / n[mine].sum()
            done, mix = np.abs(new - mix).max() < 1e-7, new
            if done:
                break
        mix = np.maximum(mix, FLOOR)
        out[number] = mix / mix.sum()
    return out


def _scored(mix: np.ndarray, total: int, vocabulary: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = blocks.unpack(left.column("payload")[0].as_py())
        block = read(docs)
        pair, context, single = _counts(block, right, "both", n_buckets)
        base = np.log10((single + 0.5) / (total + 0.5 * (vocabulary + 1)))
        share = mix[_classes(context)]
        p = share[:, 0] * _share(pair, context) + share[:, 1] * _share(single, total) + share[:, 2] / (vocabulary + 1)
        # The weights of estimates that do not exist go to the others.
        p /= share[:, 0] * (context > 0) + share[:, 1] * (total > 0) + share[:, 2]
        starts = np.append(0, block.ends[:-1])[: len(block.ends)]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        return pa.table({
            "id": docs.column("id"), "part": docs.column("part"),
            "n_tokens": pa.array(np.diff(block.ends, prepend=0), pa.int64()),
            "n_known": pa.array(add((single > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), total), pa.int64()),
            "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(np.log10(p)), pa.float64()),
        })

    return run


def scores(
    docs: DataFrame, train: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text",
    max_bytes: int = blocks.BLOCK_BYTES,
) -> DataFrame:
    """``id_col``, part, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    The model learns from the rows with ``train``; of these the rows with
    ``deleted`` teach the mixture weights against the counts of the others. Both
    are conditions on ``docs``; null counts as false. Tokens are runs without
    white space, A-Z in lower case, and one end. Scores are log10 probabilities,
    base_score that of the smoothed single words.

    A null or empty text is one end token. Without training rows every estimate
    is the even one. Null and repeated ids are scored like any others; other
    columns are ignored.
    """
    false = F.lit(False)
    part = F.when(~F.coalesce(train, false), OTHER).when(F.coalesce(deleted, false), DELETED).otherwise(COUNTED)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        part.cast("int").alias("part"),
    )
    n_buckets = blocks.value_buckets(rows)
    sent = rows.mapInArrow(
        _sent(n_buckets, max_bytes), "bucket int, block long, n int, keys binary, counted binary, deleted binary"
    )
    totals = work.written(sent.groupBy("bucket").applyInArrow(_added, TOTALS), "totals")
    sums = totals.where("bucket % 2 = 0").agg(*(F.sum(c) for c in ("n_counted", "n_both", "v_counted", "v_both"))).first()
    n_counted, n_both, v_counted, v_both = (int(x or 0) for x in sums)
    packed = rows.mapInArrow(_packed(max_bytes), blocks.SCHEMA)
    totals = totals.select("block", "bucket", "counted", "both")
    taught = (
        packed.where("block % 2 = 1").groupBy("block").cogroup(totals.where("block % 2 = 1").groupBy("block"))
        .applyInArrow(_histogram(n_counted, n_buckets), "code long, n long")
        .groupBy("code").agg(F.sum("n").alias("n"))
    )
    # At most 40 * 256 * 256 rows, whatever the corpus.
    found = taught.orderBy("code").toArrow()
    mix = weights(found.column("code").to_numpy(), found.column("n").to_numpy(), v_counted)
    schema = "id long, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return (
        packed.groupBy("block").cogroup(totals.groupBy("block"))
        .applyInArrow(_scored(mix, n_both, v_both, n_buckets), schema).withColumnRenamed("id", id_col)
    )


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, ~held_out("doc_id", 5, 1), held_out("doc_id", 5, 0))
    return scored.select(
        "doc_id", (F.col("part") == OTHER).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op3_interpolated_lm": op3_interpolated_lm}
SQL: dict[str, str] = {}
