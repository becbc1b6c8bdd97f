"""Exact search for the largest inner products with KD-trees.

Vectors are dealt to shards of a bounded size; each shard is a KD-tree of median
splits whose nodes keep tight bounding boxes. Queries go through a tree best
first: a node's bound is the largest inner product that its box allows, and the
search of a shard ends when no bound can reach the query's kth score. That score
comes from a first search of one shard per query and goes along to all others.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storeflow.llm import work
from storeflow.llm.tables import table

SHARD_ROWS = 8192
QUERY_BLOCK = 32_768  # queries that meet a shard in one task
LEAF_ROWS = 64
QUERY_ROWS = 1024
LARGEST = 1 << 63  # an integer component is below it
SAFE = 1 << 62  # sums of products up to here are exact in 64 bits
EMPTY = -(1 << 63)


def _whole(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(-1, dim)


class Tree:
    """Median splits along the widest side until a leaf has at most ``LEAF_ROWS`` rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        rows = [np.arange(len(ids))]
        self.ids, self.vectors = ids[order], vectors[order]
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = rows
        low, high = [], []
        at = 0
        while at < len(rows):
            mine = rows[at]
            box = self.vectors[mine]
            low.append(box.min(0))
            high.append(box.max(0))
            side = int(np.argmax(high[-1] - low[-1]))
            if len(mine) <= LEAF_ROWS or low[-1][side] == high[-1][side]:
                self.children.append(None)
            else:
                by = mine[np.argsort(box[:, side], kind="stable")]
                self.children.append((len(rows), len(rows) + 1))
                rows += [by[: len(by) // 2], by[len(by) // 2 :]]
            at += 1
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """The best (score, -id) of the shard, of those that can be among the k best with a kth score of ``least``."""
        found: list[tuple[int, int]] = []
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            pair = self.children[node]
            if pair:
                for child in pair:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-int(bounds[child]), child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            for at in np.flatnonzero(scores >= least).tolist():
                name = int(self.ids[rows[at]])
                if name != own:
                    item = (int(scores[at]), -name)
                    if len(found) < k:
                        heapq.heappush(found, item)
                    elif item > found[0]:
                        heapq.heapreplace(found, item)
            if len(found) == k:
                least = max(least, found[0][0])
        return found


def _searched(k: int):
    """A shard with a block of queries; the bounds of some queries at a time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            vectors, most = _whole(left.column("v"), dim), _whole(right.column("v"), dim)
            large = dim * np.abs(vectors.astype(float)).max() * np.abs(most.astype(float)).max() >= SAFE
            kind = object if large else np.int64  # objects: whole numbers of any size
            tree = Tree(left.column("id").to_numpy(), vectors.astype(kind))
            for start in range(0, right.num_rows, QUERY_ROWS):
                part = right.slice(start, QUERY_ROWS)
                queries = _whole(part.column("v"), dim).astype(kind)
                bounds = tree.bounds(queries)
                names, least = part.column("id").to_pylist(), part.column("least").to_pylist()
                for name, query, bound, low in zip(names, queries, bounds, least):
                    out += [(name, -other, score) for score, other in tree.search(name, query, bound, k, low)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score long"


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 1024, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` vectors of the largest inner product for each query: query_id, rank, vec_id, score.

    Components become floor(scale * component); scores are whole numbers, ties
    go to the smaller id. A query's own id is no candidate. Queries are rows of
    the same form; both sides go to a tree shard by shard, queries in blocks.

    Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part; vectors meet only vectors of their length. Rows with
    the same id are one vector, the least of them. Sums are exact for components of
    any size; a component or a score among the ``k`` best of a shard that does not fit in 64 bits is an error.
    """
    def clean(rows: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        large = F.exists(v, lambda x: F.abs(x * scale) >= float(LARGEST))
        whole = F.when(large, F.raise_error(F.lit("a component does not fit in 64 bits"))).otherwise(
            F.transform(v, lambda x: F.floor(x * scale).cast("long"))
        )
        return (
            rows.where(F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0) & finite)
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), F.size(v).alias("dim"), whole.cast("array<long>").alias("v"))
            .groupBy("id", "dim").agg(F.min("v").alias("v"))
        )

    all_rows = work.written(clean(vectors), "vectors")
    asked = work.written(clean(queries), "queries")
    # Shards by the number of vectors of a length, blocks by the number of queries: one small row per length.
    sizes = all_rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("n_shards")).join(
        asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n_blocks")), "dim"
    )
    key = ("dim", "shard", "block")
    dealt = all_rows.join(sizes, "dim").select(
        "dim", F.pmod(F.xxhash64("id"), "n_shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "id", "v",
    ).groupBy(*key)
    ready = asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "n_blocks").cast("int"))
    home = F.pmod(F.xxhash64("id"), "n_shards").cast("int")

    def search(rows: DataFrame) -> DataFrame:
        return dealt.cogroup(rows.groupBy(*key)).applyInArrow(_searched(k), FOUND)

    first = ready.select("dim", home.alias("shard"), "block", "id", "v", F.lit(EMPTY).alias("least"))
    seen = work.written(search(first), "first")
    # The kth score of the first shard bounds the kth score of all.
    kth = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(EMPTY)).alias("least"))
    others = F.array_except(F.sequence(F.lit(0), F.col("n_shards") - 1), F.array(home))
    rest = (
        ready.join(kth, "id", "left").withColumn("shard", F.explode(others))
        .select("dim", "shard", "block", "id", "v", F.coalesce("least", F.lit(EMPTY)).alias("least"))
    )
    found = seen.unionAll(search(rest))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_products(rows, rows.where("vec_id % 100 = 0"))


SQL = {
    "op2_top_products": """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS (
        SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM whole
    ), products AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
        FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0 GROUP BY ALL
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM products
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """
}
QUERIES = {"op2_top_products": op2_top_products}
