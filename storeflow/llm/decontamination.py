"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of words that ignores some of its positions.
Seeds of the benchmark and of the documents are joined by their hash; around
each hit the two word sequences are laid side by side and the longest stretch
that agrees in a given share of its positions is verified.

The benchmark's seeds are held by every task, so they are read in parts of a
bounded number of words; a larger benchmark takes a pass for each part.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks
from storeflow.llm.tables import table

# Scripts without spaces: Thai to Myanmar, Khmer, kana, Han. Each letter is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|(?=[^\W_])[{UNSPACED}]")
# Positions that count. Any fifth of substituted words within thirteen to
# twenty-five leaves one of these masks untouched somewhere (found by exhaustive
# search); longer stretches have such a part.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3, 5, 6), (0, 1, 2, 5, 9, 10))
# The same for stretches of five words and more.
SHORT = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
MIN_WORDS = 13
LEAST_WORDS = 5  # shorter items are too common to drop a document; they are found on request, as a whole
EQUAL_PERCENT = 80
PART_WORDS = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
SCHEMA = "id long, item long, doc_word int, item_word int, n_words int, n_equal int"


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode())
        return value


def _words(text: str, hashes: Hashes) -> np.ndarray:
    found = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for at in mask:
        out = (out ^ words[at : at + n]) * FACTOR
        out ^= out >> np.uint64(29)
    return out


def masks(words: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which any stretch of at least ``words`` words that agrees in ``percent`` hundredths holds a hit."""
    if percent >= EQUAL_PERCENT and words >= LEAST_WORDS:
        return MASKS if words >= MIN_WORDS else SHORT
    # The longest run that is left between the places that differ.
    equal = [(n, -(-percent * n // 100)) for n in range(words, 2 * words)]
    return (tuple(range(max(1, min(-(-e // (n - e + 1)) for n, e in equal)))),)


def whole(words: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """The mask for an item of ``words`` words that agrees as a whole: its longest run between the places that differ."""
    equal = -(-percent * words // 100)
    return (tuple(range(max(1, -(-equal // (words - equal + 1))))),) if words else ()


@dataclass
class Index:
    """Seeds of one part of the benchmark: for each mask the sorted hashes with their item and position."""

    items: list[tuple[int | None, np.ndarray]]
    min_words: int
    percent: int
    least_item: int = LEAST_WORDS

    def __post_init__(self):
        self.tables = []
        least = [min(self.min_words, len(w)) for _, w in self.items]
        wanted = [
            () if len(w) < self.least_item else whole(n, self.percent) if len(w) < min(LEAST_WORDS, self.min_words)
            else masks(n, self.percent) for n, (_, w) in zip(least, self.items)
        ]
        for mask in dict.fromkeys(mask for own in wanted for mask in own):
            use = [(n, _seeds(w, mask)) for n, (_, w) in enumerate(self.items) if mask in wanted[n]]
            seeds = np.concatenate([s for _, s in use]) if use else np.empty(0, np.uint64)
            item = np.concatenate([np.full(len(s), n) for n, s in use]) if use else np.empty(0, int)
            at = np.concatenate([np.arange(len(s)) for _, s in use]) if use else np.empty(0, int)
            order = np.argsort(seeds, kind="stable")
            passes = np.zeros(1 << FILTER_BITS, bool)
            passes[(seeds >> np.uint64(64 - FILTER_BITS)).astype(int)] = True
            self.tables.append((mask, seeds[order], item[order], at[order], passes))

    def find(self, texts: list[np.ndarray]) -> list[tuple[int, int | None, int, int, int, int]]:
        """(text, item, place in the text, place in the item, words, equal words) of every leak."""
        words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        shifts = set()
        for mask, seeds, item, at, passes in self.tables:
            own = _seeds(words, mask)
            hits = np.flatnonzero(passes[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(seeds, own[hits], "left")
            n = np.searchsorted(seeds, own[hits], "right") - low
            doc = np.searchsorted(ends, hits, "right")
            n[np.searchsorted(ends, hits + mask[-1], "right") != doc] = 0
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            hits, doc = np.repeat(hits, n), np.repeat(doc, n)
            shifts.update(zip(doc.tolist(), item[entry].tolist(), (hits - at[entry]).tolist()))
        out = []
        for doc, number, shift in sorted(shifts):
            name, item = self.items[number]
            start = max(shift, int(ends[doc - 1]) if doc else 0)
            stop = min(shift + len(item), int(ends[doc]))
            equal = words[start:stop] == item[start - shift : stop - shift]
            if best := passage(equal, self.percent, self.min_words, len(item)):
                base = int(ends[doc - 1]) if doc else 0
                first, length, same = best
                out.append((doc, name, start - base + first, start - shift + first, length, same))
        return out


def longest(equal: np.ndarray, percent: int) -> tuple[int, int, int] | None:
    """(start, length, equal places) of the longest stretch that is equal in ``percent`` hundredths; the first on a tie."""
    places = np.flatnonzero(equal)
    if not len(places):
        return None
    # 100 * equal - percent * length must not be negative: a difference of prefix sums.
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    starts = places[np.concatenate([[True], sums[places][1:] < np.minimum.accumulate(sums[places])[:-1]])]
    least = -sums[starts]  # rising: the first start that is low enough begins the longest stretch
    stops = places + 1
    at = np.searchsorted(least, -sums[stops], "left")
    length = np.where(at < len(starts), stops - starts[np.minimum(at, len(starts) - 1)], 0)
    best = int(np.argmax(length))
    if length[best] <= 0:
        return None
    first = int(stops[best] - length[best])
    return first, int(length[best]), int(equal[first : stops[best]].sum())


def passage(equal: np.ndarray, percent: int, least: int, words: int) -> tuple[int, int, int] | None:
    """``longest`` of at least ``least`` places, or else all places of an item of ``words`` that is equal enough as a whole."""
    best = longest(equal, percent)
    if best and best[1] >= least:
        return best
    same = int(equal.sum())
    return (0, words, same) if len(equal) == words and 100 * same >= percent * words else None


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_words: int):
    """The benchmark in parts of about ``part_words`` words, one at a time."""
    rows = blocks.narrow(benchmark, id_col, text_col)
    letters = F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    words = rows.agg(F.sum(F.size(F.split("text", r"[\s]+")) + letters)).first()[0] or 0
    n = max(1, -(-words // part_words))
    for part in range(n):
        found = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == part).orderBy("id", "text").toArrow()
        yield list(zip(found.column("id").to_pylist(), found.column("text").to_pylist()))


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, min_words: int, percent: int, part_words: int, least_item: int):
    spark = benchmark.sparkSession
    for items in _parts(benchmark, id_col, text_col, part_words):
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, items, min_words, percent, least_item))


_built: dict[str, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast part, built once in a worker."""
    key, items, min_words, percent, least_item = shared.value
    if key not in _built:
        hashes = Hashes()
        _built.clear()
        _built[key] = Index([(i, _words(t, hashes)) for i, t in items], min_words, percent, least_item)
    return _built[key]


def _found(shared, batches, text: str):
    """Each batch in slices of a few million bytes, with its leaks."""
    index, hashes = _index(shared), Hashes()
    for batch in batches:
        column = batch.column(text)
        start, size, texts = 0, 0, []
        for row in range(len(column)):
            texts.append(_words(column[row].as_py() or "", hashes))
            size += len(texts[-1])
            if size > 500_000 or row == len(column) - 1:
                yield batch.slice(start, row + 1 - start), index.find(texts)
                start, size, texts = row + 1, 0, []
            if len(hashes) > 500_000:
                hashes = Hashes()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_words: int = MIN_WORDS, percent: int = EQUAL_PERCENT,
    part_words: int = PART_WORDS, least_item: int = LEAST_WORDS,
) -> DataFrame:
    """The passages of the benchmark in every whole text: ``id_col``, ``item_col``, doc_word, item_word, n_words, n_equal.

    Words are runs of letters and digits in lower case, or single letters of
    scripts without spaces. A leak is a stretch of at
    least ``min_words`` words, or a whole item of any length, which agrees
    with an item in ``percent`` hundredths of its places and, unless it is the
    whole item, begins and ends with an equal word; there is one row for
    each item and relative position. Items of fewer than ``least_item``
    words are not looked for, nor are items without words. Null and empty texts and an empty benchmark give no rows; null and
    repeated ids are reported as they are; other columns are ignored.
    """
    rows = blocks.narrow(docs, id_col, text_col)
    out = None
    for shared in _indexes(benchmark, item_col, item_text_col, min_words, percent, part_words, least_item):

        def run(batches, shared=shared):
            for batch, found in _found(shared, batches, "text"):
                ids = batch.column("id").to_pylist()
                lists = list(zip(*[(ids[row], *rest) for row, *rest in found])) or [[]] * 6
                types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                names = ["id", "item", "doc_word", "item_word", "n_words", "n_equal"]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(lists, types)], names=names)

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_words: int = MIN_WORDS, percent: int = EQUAL_PERCENT,
    part_words: int = PART_WORDS, least_item: int = LEAST_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no leak as ``leaks`` defines it.

    Items of fewer than ``least_item`` words drop nothing: clean texts hold them too.
    """
    for shared in _indexes(benchmark, item_col, item_text_col, min_words, percent, part_words, least_item):

        def run(batches, shared=shared):
            for batch, found in _found(shared, batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in found]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_item=1)


QUERIES = {"op9_decontamination": op9_decontamination}
SQL: dict[str, str] = {}
