"""BPE encoding and decoding through a table of distinct words.

Words (runs without white space) are split in tasks over blocks of documents.
The distinct words of each block go to a bucket by their hash; a bucket encodes
each of its distinct words once, and the ids go back to the blocks that hold the
word, where documents are put together by position. What moves is a word of a
block, packed with others, not a row per token.
"""

from __future__ import annotations

import array
import functools
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks
from storeflow.llm.tables import table

# Fixed values of the tokenizer file format: White_Space of Unicode, the split
# pattern, and the special tokens, which are found before anything else.
WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
END = "</w>"
BLOCK_BYTES = 8 << 20
LEVEL = 4  # of compression: what moves counts for more here than the time to pack it
BATCH_DOCS = 256  # documents that go back to Spark at once


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a word-level BPE file."""

    def __init__(self, text: str):
        data = json.loads(text)
        self.ids = data["model"]["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.ranks = {tuple(pair): n for n, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pieces = {n: piece for piece, n in [*self.ids.items(), *self.special.items()]}
        #: The table of pieces: the place of a piece is its id.
        self.pieces = pa.array([pieces.get(n) for n in range(max(pieces, default=-1) + 1)], pa.string())
        self.id_type = pa.uint16() if len(self.pieces) <= 1 << 16 else pa.int32()
        self.marks = {token[0] for token in self.special if token}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = _byte_letters()

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece: the lowest-ranked pair is joined first, the leftmost on a tie."""
        parts = [self.letters[b] for b in piece.encode()]
        parts[-1] += END
        ranks, last = self.ranks, len(self.ranks)
        while len(parts) > 1:
            found = [ranks.get(pair, last) for pair in zip(parts, parts[1:])]
            best = min(found)
            if best == last:
                break
            joined, at = [], 0
            while at < len(parts):
                if at < len(found) and found[at] == best:
                    joined.append(parts[at] + parts[at + 1])
                    at += 2
                else:
                    joined.append(parts[at])
                    at += 1
            parts = joined
        return [self.ids[p] for p in parts if p in self.ids]

    def word(self, word: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(word) if not self.marks.isdisjoint(word) else (word,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # Letter by letter, so a sigma at the end of a word is not special.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for piece in PIECE.findall(plain):
                    out += self.merged(piece)
        return out


@functools.lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


class Slots(dict):
    """Numbers words by their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        return slot


def _words(rows: DataFrame, n_buckets: int, max_bytes: int) -> DataFrame:
    """(bucket, block, words): the distinct words of each block, sorted, dealt by a hash of the word."""

    def run(batches):
        for number, block in blocks.tables(batches, max_bytes):
            found: set[str] = set()
            for text in block.column("text"):
                found.update(WORD.findall(text.as_py()))
            dealt: list[list[str]] = [[] for _ in range(n_buckets)]
            for word in sorted(found):
                dealt[zlib.crc32(word.encode()) % n_buckets].append(word)
            for bucket, words in enumerate(dealt):
                if words:
                    data = blocks.payload(pa.table([pa.array(words, pa.string())], names=["word"]), LEVEL)
                    yield pa.record_batch(
                        [pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary())],
                        names=["bucket", "block", "words"],
                    )

    return rows.mapInArrow(run, "bucket int, block long, words binary")


def _encoded(vocabulary):
    """The distinct words of a bucket, each encoded once, and their ids for each block that has them."""

    def run(rows: pa.Table) -> pa.Table:
        known = _vocabulary(vocabulary.value)
        parts = [blocks.unpack(data.as_py()).column("word") for data in rows.column("words")]
        words = pa.chunked_array([c for p in parts for c in p.chunks], pa.string()).combine_chunks()
        coded = words.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        ids = pa.array([known.word(w) for w in coded.dictionary.to_pylist()], pa.list_(known.id_type))
        out, at = [], 0
        for part in parts:
            mine = ids.take(coded.indices.slice(at, len(part)))
            out.append(blocks.payload(pa.table([mine], names=["ids"]), LEVEL))
            at += len(part)
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return run


def _assemble(vocabulary, n_buckets: int):
    """Documents of a block from its words' ids: positions give the order of the ids and of their pieces."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _vocabulary(vocabulary.value)
        docs = blocks.unpack(left.column("payload")[0].as_py())
        slots, places, ends = Slots(), array.array("i"), [0]
        for text in docs.column("text"):
            places.extend(map(slots.__getitem__, WORD.findall(text.as_py())))
            ends.append(len(places))
        dealt: list[list[int]] = [[] for _ in range(n_buckets)]
        for word in sorted(slots):
            dealt[zlib.crc32(word.encode()) % n_buckets].append(slots[word])
        order, parts = [], []
        for bucket, data in zip(right.column("bucket").to_pylist(), right.column("ids")):
            parts += blocks.unpack(data.as_py()).column("ids").chunks
            order += dealt[bucket]
        found = pa.chunked_array(parts, pa.list_(known.id_type)).combine_chunks()
        if sorted(order) != list(range(len(found))) or len(found) != len(slots):
            raise ValueError("the words of a block differ between two reads of its input")
        del slots, dealt
        # The ids of each distinct word by its slot, then of each position by the slot of its word.
        of_slot = found.take(pa.array(np.argsort(order), pa.int64()))
        # Ids meet their pieces: a join with the table of pieces, whose rows are in the order of ids.
        texts = pc.binary_join(pa.ListArray.from_arrays(of_slot.offsets, known.pieces.take(of_slot.flatten())), " ")
        at = pa.array(np.frombuffer(places, np.int32) if places else np.empty(0, np.int32))
        by_place = of_slot.take(at)
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(by_place).to_numpy())])
        ids = pa.ListArray.from_arrays(pa.array(counts[ends], pa.int32()), by_place.flatten().cast(pa.int32()))
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.take(at))
        decoded = pc.binary_join(words, " ")
        if pc.min(pc.list_value_length(of_slot)).as_py() == 0:  # a word without ids leaves no space behind
            decoded = pa.array([" ".join(filter(None, w.as_py())) for w in words], pa.string())
        out = pa.table([docs.column("id"), ids, decoded], names=["id", "ids", "decoded"])
        return pa.Table.from_batches(out.to_batches(max_chunksize=BATCH_DOCS))

    return run


def encode(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Ids of every whole text and the text they decode to: ``id_col``, ids array<int>, decoded.

    ``tokenizer_json`` is the content of a tokenizer file of the word-end kind:
    NFC, lower case, white space dropped, byte-level letters, no decoder, so the
    decoded text is the pieces joined by spaces. Special tokens in a text count
    as such; truncation and padding are not applied.

    Null and empty texts give no ids and an empty text. Rows with a null or
    repeated id are encoded like any other; other columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary: a few MB
    rows = blocks.narrow(docs, id_col, text_col)
    n_buckets = blocks.value_buckets(rows)
    words = _words(rows, n_buckets, max_bytes)
    coded = words.groupBy("bucket").applyInArrow(_encoded(vocabulary), "block long, bucket int, ids binary")
    joined = blocks.pack(rows, max_bytes, LEVEL).groupBy("block").cogroup(coded.groupBy("block"))
    schema = "id long, ids array<int>, decoded string"
    return joined.applyInArrow(_assemble(vocabulary, n_buckets), schema).withColumnRenamed("id", id_col)


def vocabulary_file(path: str | None = None) -> str:
    """The content of a tokenizer file; by default the public one that the queries use."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def op1_bpe_words(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_file(tokenizer)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe_words": op1_bpe_words}
SQL: dict[str, str] = {}
