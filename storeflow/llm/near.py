"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles. In every tree documents
branch by a minwise token (the least shingle under the tree's hash function);
documents that share it share a node. Small nodes are compared exhaustively on
the full sets; members of larger ones branch again by several minwise tokens
under hash functions of the node's own, and so on down the tree. A pair survives
all branchings of a tree with a chance that does not fall with their number
(``survival``); trees are repeated until one of them finds it with the recall
asked for. Nodes that branching does not make smaller are compared in pairs of blocks.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import blocks, work
from storeflow.llm.tables import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 5
RECALL = 1 - 1e-7  # of a pair just at the threshold, whatever the depth of its trees
LEAF = 1000  # documents that are compared at once; larger nodes branch
DEPTH = 10  # branchings at most; what is still larger is dealt to pairs of blocks
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value sent to another, evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def branches(percent: int) -> int:
    """Minwise tokens per branching: a pair of the threshold's similarity shares one and a half or more of them on average."""
    return math.ceil(150 / percent)


def survival(percent: int) -> float:
    """The chance that a pair of that similarity stays together in some node of a tree of any depth.

    The pair's shared nodes are a branching process; q, the chance that it never
    dies out below a shared node, is a fixed point.
    """
    q = 1.0
    for _ in range(1000):
        q = 1 - (1 - percent / 100 * q) ** branches(percent)
    return percent / 100 * q


def trees_for(percent: int, recall: float) -> int:
    """Independent trees of which one finds a pair of the threshold's similarity with a chance of ``recall``."""
    lost = 1 - survival(percent)
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost))) if lost > 0 else 1


class Hashes(dict):
    """64-bit hashes of byte strings, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[list[bytes]], hashes: Hashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words, end to end, and how many each has.

    A shorter text has one run, the whole.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    h = np.fromiter(map(hashes.__getitem__, itertools.chain.from_iterable(texts)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    runs = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    first = np.repeat(ends - lengths - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    span = np.repeat(np.minimum(lengths, size), runs)
    padded = np.append(h, np.zeros(size, np.uint64))
    out = mixed(span.astype(np.uint64))
    for at in range(size):
        out = np.where(at < span, mixed(out * PRIME + padded[first + at]), out)
    stops = np.cumsum(runs)
    for start, stop in zip((stops - runs).tolist(), stops.tolist()):
        out[start:stop].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(stops - runs)[runs > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[stops] - kept[stops - runs]


def _texts(batch: pa.RecordBatch, most: int = 4 << 20):
    """Slices of a batch with their words, a few million bytes each."""
    start, size, texts = 0, 0, []
    for row, text in enumerate(batch.column("text")):
        data = text.as_buffer().to_pybytes()
        texts.append(WORD.findall(data.lower()))
        size += len(data)
        if size > most or row == batch.num_rows - 1:
            yield batch.slice(start, row + 1 - start), texts
            start, size, texts = row + 1, 0, []


def _sets(rows: DataFrame, size: int, tokens: int) -> DataFrame:
    """(id, text_id, n, sid, tokens): the minwise tokens, or the whole set for 0 tokens; an empty set has no sid."""
    seeds = mixed(np.arange(1, max(tokens, 1) + 1, dtype=np.uint64) * PRIME)

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            for part, texts in _texts(batch):
                values, n = shingle_sets(texts, hashes, size)
                ends = np.cumsum(n)
                sids = [
                    xxhash.xxh3_128_digest(values[e - k : e].tobytes()) if k else None
                    for e, k in zip(ends.tolist(), n.tolist())
                ]
                if tokens:
                    least = np.zeros((len(n), tokens), np.int64)
                    some = np.flatnonzero(n)
                    if len(some):
                        spread = mixed(values)
                        for number, seed in enumerate(seeds):
                            least[some, number] = np.minimum.reduceat((spread ^ seed) * (seed | np.uint64(1)), (ends - n)[some]).view(np.int64)
                    flat, ends = least.ravel(), np.arange(1, len(n) + 1) * tokens
                else:
                    flat = values.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.record_batch(
                    [part.column("id"), part.column("text_id"), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), lists],
                    names=["id", "text_id", "n", "sid", "tokens"],
                )
                if len(hashes) > 500_000:
                    hashes = Hashes()

    marked = rows.select("id", F.xxhash64("text").alias("text_id"), "text")
    return marked.mapInArrow(run, "id long, text_id long, n long, sid binary, tokens array<long>")


def compare(sets: list[np.ndarray], percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """All pairs of sorted sets of at least ``percent`` similarity, by a product of their incidence matrix."""
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(code)[code] > 1
    _, code = np.unique(code[often], return_inverse=True)
    owner = owner[often]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(code.max(initial=-1)) + 1, columns):
        low, high = np.searchsorted(code, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[low:high], code[low:high] - start] = 1
        common += part @ part.T
    sizes = np.array([len(s) for s in sets])
    common = common.astype(np.int64)
    a, b = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes - common), 1))
    return list(zip(a.tolist(), b.tolist()))


def _compared(percent: int):
    """Exhaustive comparison of the small nodes of a bucket; only links between parts not yet connected."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending"), ("id", "ascending")])
        node = rows.column("node").to_numpy()
        ids, roots = rows.column("id").to_pylist(), rows.column("root").to_pylist()
        lists = rows.column("set").combine_chunks()
        starts = np.append(np.flatnonzero(np.diff(node, prepend=node[0] - 1 if len(node) else 0)), len(node))
        out = []
        for start, stop in zip(starts.tolist(), starts[1:].tolist()):
            part = {}

            def top(x):
                while part.get(x, x) != x:
                    x = part[x]
                return x

            sets = [lists[i].values.to_numpy() for i in range(start, stop)]
            for a, b in compare(sets, percent):
                x, y = top(roots[start + a]), top(roots[start + b])
                if x != y:
                    part[y] = x
                    out.append((ids[start + a], ids[start + b]))
        return pa.table([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], names=["a", "b"])

    return run


def _branched(count: int):
    """The children (node, id) of each id's ``nodes``: ``count`` minwise tokens under hash functions of each node."""
    offsets = np.arange(1, count + 1, dtype=np.uint64) * PRIME

    def run(batches):
        for batch in batches:
            lists, sets = batch.column("nodes"), batch.column("set")
            children = []
            for nodes, values in zip(lists, sets):
                values = values.values.to_numpy().view(np.uint64)
                own = nodes.values.to_numpy().view(np.uint64)
                seeds = mixed(own[:, None] + offsets).ravel()
                least = np.array([mixed(values ^ seed).min() for seed in seeds], np.uint64)
                children.append(mixed(least * PRIME + seeds).view(np.int64))
            sizes = [len(c) for c in children]
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            nodes = pa.array(np.concatenate(children) if children else np.empty(0, np.int64))
            yield pa.record_batch([nodes, batch.column("id").take(at)], names=["node", "id"])

    return run


def _check(full: DataFrame, percent: int):
    """Keeps the pairs (a, b) whose sets in ``full`` (id, set) are similar."""

    def check(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("id").alias("a"), F.col("set").alias("a_set"))
        right = full.select(F.col("id").alias("b"), F.col("set").alias("b_set"))
        both = pairs.join(left, "a").join(right, "b")
        a, b = F.size("a_set"), F.size("b_set")
        # A set much smaller than the other cannot reach the threshold.
        return (
            both.where(100 * F.least(a, b) >= percent * F.greatest(a, b))
            .withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
            .where(100 * F.col("common") >= percent * (a + b - F.col("common")))
            .select("a", "b")
        )

    return check


def near_links(
    spark: SparkSession, rows: DataFrame, sets: DataFrame, shingle: int, percent: int, trees: int, depth: int
) -> DataFrame:
    """Links (a, b) between distinct sets that connect all pairs of at least ``percent`` similarity."""
    distinct = sets.where("sid is not null").select("sid", "tokens").dropDuplicates(["sid"])
    paths = distinct.select(
        F.col("sid").alias("id"),
        F.posexplode(F.slice("tokens", 1, trees)).alias("tree", "token"),
    ).select(F.xxhash64("tree", "token").alias("node"), "id")
    members = work.shared(paths)
    needed = members.select(F.col("id").alias("sid")).distinct()
    # One row of each set that shares a node: texts are shuffled instead of sets, which are larger.
    key = F.xxhash64("id", "text_id").alias("key")
    one = sets.select("sid", key, "text_id").join(needed, "sid", "left_semi")
    one = one.groupBy("sid").agg(F.min(F.struct("key", "text_id")).alias("one")).select("one.*")
    texts = rows.select("id", F.xxhash64("text").alias("text_id"), "text").select(key, "text_id", "id", "text")
    texts = texts.join(one, ["key", "text_id"], "left_semi").dropDuplicates(["key", "text_id"])
    full = work.written(_sets(texts, shingle, 0).select(F.col("sid").alias("id"), F.col("tokens").alias("set")), "sets")

    n_buckets = 4 * blocks.buckets(spark)

    def compare(nodes: DataFrame) -> DataFrame:
        # Small nodes share a bucket; a pair of blocks is one of its own.
        bucket = F.when(F.col("block"), F.col("node")).otherwise(F.pmod("node", F.lit(n_buckets)))
        rows = nodes.join(full, "id").select("node", "id", "root", "set", bucket.alias("bucket"))
        return rows.groupBy("bucket").applyInArrow(_compared(percent), "a binary, b binary")

    def branch(members: DataFrame, own: DataFrame | None):
        # A document is in at most trees * branches ** depth nodes; its set is read once for all of them.
        nodes = members.groupBy("id").agg(F.collect_list("node").alias("nodes"))
        own = work.written(nodes.join(full if own is None else own, "id").select("id", "nodes", "set"), "sets")
        children = work.written(own.mapInArrow(_branched(branches(percent)), "node long, id binary"), "children")
        sets = own.select("id", "set")
        return children, _check(sets, percent), sets

    return work.connect(members, _check(full, percent), compare, LEAF, branch, depth)


def _placed(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, trees: int | None, depth: int,
    recall: float,
) -> DataFrame:
    """(id, text_id, n, root, component_id) for every row; root names the component, and is null for an empty set."""
    spark = docs.sparkSession
    trees = trees or trees_for(percent, recall)
    rows = blocks.narrow(docs, id_col, text_col)
    sets = work.written(_sets(rows, shingle, trees), "tokens")
    links = near_links(spark, rows, sets, shingle, percent, trees, depth)
    # Rows of one id are one document, whatever their texts.
    firsts = sets.where("id is not null and sid is not null").groupBy("id").agg(
        F.min("sid").alias("a"), F.max("sid").alias("b")
    ).where("a != b")
    several = sets.join(firsts.select("id", "a"), "id").where("sid != a").select("a", F.col("sid").alias("b"))
    roots = work.written(work.components(links.unionAll(several)), "roots")
    least = (
        sets.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"))
        .join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .select("sid", F.coalesce("root", "sid").alias("root"), "id")
    )
    names = least.groupBy("root").agg(F.min("id").alias("component_id"))
    named = least.join(names, "root").select("sid", "root", "component_id")
    return sets.select("id", "text_id", "n", "sid").join(named, "sid", "left").select(
        "id", "text_id", "n", "root",
        F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80,
    trees: int | None = None, depth: int = DEPTH, recall: float = RECALL,
) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept for every row of ``docs``.

    Words are runs without white space, A-Z in lower case. Rows are linked when
    the Jaccard similarity of their sets is ``percent`` hundredths or more; a
    component is named by its smallest id, whose rows are kept.

    A null, empty or blank text has an empty set: linked with nothing, kept. A
    row with a null id takes part in links, is not kept beside rows that have an
    id, and is kept in a component without any id. Rows with the same id count
    as one document with several texts. Other columns are ignored. A link of just
    ``percent`` hundredths is found with a chance of ``recall``, closer ones with
    a higher one; ``trees`` sets the number of trees instead, and ``depth`` is the
    largest number of branchings below a tree's first nodes.
    """
    return _placed(docs, id_col, text_col, shingle, percent, trees, depth, recall).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80,
    trees: int | None = None, depth: int = DEPTH, recall: float = RECALL,
) -> DataFrame:
    """One row of ``docs``, all columns, of each component, and all rows with empty sets.

    The row with the smallest id stays (null ids come last), of several such rows
    the one whose text has the smallest hash; rows equal in id and text count once.
    """
    placed = work.written(_placed(docs, id_col, text_col, shingle, percent, trees, depth, recall), "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_id")).alias("row")
    winners = placed.where("root is not null").groupBy("root").agg(first).select("row.id", "row.text_id")
    winners = winners.unionAll(placed.where("root is null").select("id", "text_id")).distinct()
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    keys = winners.select(F.xxhash64("id", "text_id").alias("key"))
    # The row in a struct: its columns may have any names.
    packed = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = packed.join(keys, "key", "left_semi").dropDuplicates(["key"])
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op5_near_dedup": op5_near_dedup}
SQL: dict[str, str] = {}
