"""Exact k-means on whole numbers through dictionaries of subvectors.

Vectors are packed into shards. In a shard every block of dimensions is replaced
by codes into a dictionary of its distinct subvectors; the width of the blocks is
the one for which dictionaries and codes together are smallest, so nothing is
lost and nothing has to be tuned. A round computes the distance of every
dictionary entry to every centroid once, and the distance of a vector is the sum
over its codes. Sums of clusters come from counts of codes in the same way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import work
from storeflow.llm.tables import importable, table

SHARD_VALUES = 1 << 20  # components of a shard
LIMB = 1 << 90  # sums beyond it travel in several parts
SHARD = "ids array<long>, width int, sizes array<int>, entries array<double>, codes array<int>"
SUMS = "cluster int, at int, limb int, total decimal(38,0)"
ASSIGNED = "vec_id long, cluster int, distance decimal(38,0)"
COUNT = -1  # the component number under which sizes of clusters travel


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) / scale: whole steps that stay finite for every finite x, without negative zeros."""
    with np.errstate(over="ignore"):
        steps = np.floor(values * scale)
    return np.where(np.isfinite(steps), steps / scale, values) + 0.0


def whole(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """The integers behind :func:`scaled`, as Python's where they are beyond ``limit``."""
    if not values.size or np.abs(values).max() <= limit / scale:
        return (values * scale).astype(np.int64)
    exact = [int(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def encoded(values: np.ndarray) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(block width, entries per block, entries block by block, codes of every row).

    Blocks start one dimension wide; neighbours merge, two codes into one, while
    their number is even. Kept is the width with the least work in a round.
    """
    rows, dim = values.shape
    columns = [np.unique(values[:, d], return_index=True, return_inverse=True) for d in range(dim)]
    firsts, codes = [c[1] for c in columns], [c[2].ravel() for c in columns]
    width, best = 1, None
    while True:
        cost = width * sum(len(f) for f in firsts) + rows * len(codes)
        if best is None or cost < best[0]:
            best = (cost, width, firsts, codes)
        if len(codes) % 2:
            break
        paired = []
        for a in range(0, len(codes), 2):
            both = codes[a].astype(np.int64) * len(firsts[a + 1]) + codes[a + 1]
            paired.append(np.unique(both, return_index=True, return_inverse=True))
        firsts, codes, width = [p[1] for p in paired], [p[2].ravel() for p in paired], width * 2
    _, width, firsts, codes = best
    entries = [values[f, b * width : (b + 1) * width].ravel() for b, f in enumerate(firsts)]
    return width, [len(f) for f in firsts], np.concatenate(entries), np.stack(codes, 1).astype(np.int32)


def _packed(dim: int, scale: int, shard_values: int):
    """Input rows (id, v) to shards of a bounded number of components."""
    most = max(1, shard_values // dim)

    def shard(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        width, sizes, entries, codes = encoded(scaled(np.concatenate(parts), scale))
        return pa.record_batch({
            "ids": pa.array([ids], pa.list_(pa.int64())), "width": pa.array([width], pa.int32()),
            "sizes": pa.array([sizes], pa.list_(pa.int32())), "entries": pa.array([entries], pa.list_(pa.float64())),
            "codes": pa.array([codes.ravel()], pa.list_(pa.int32())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                piece = batch.slice(start, most - len(ids))
                start += piece.num_rows
                ids += piece.column("id").to_pylist()
                parts.append(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                if len(ids) == most:
                    yield shard(ids, parts)
                    ids, parts = [], []
        if ids:
            yield shard(ids, parts)

    return run


class Shard:
    """One row of the shard table with its dictionaries as integers."""

    def __init__(self, batch: pa.RecordBatch, at: int, scale: int, limit: int):
        field = lambda name: batch.column(name)[at].values
        self.ids = field("ids").to_pylist()
        self.width, sizes = batch.column("width")[at].as_py(), field("sizes").to_pylist()
        entries = whole(field("entries").to_numpy(zero_copy_only=False), scale, limit)
        ends = np.cumsum([0, *sizes]) * self.width
        self.blocks = [entries[a:b].reshape(-1, self.width) for a, b in zip(ends[:-1], ends[1:])]
        self.codes = field("codes").to_numpy().reshape(len(self.ids), len(sizes))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid, entry by entry and then by code."""
        total = 0
        for b, entries in enumerate(self.blocks):
            near = centroids[:, b * self.width : (b + 1) * self.width]
            table = ((entries[:, None, :] - near[None, :, :]) ** 2).sum(-1)
            total = total + table[self.codes[:, b]]
        return total

    def add_sums(self, cluster: np.ndarray, sums: list[list[int]], counts: list[int]) -> None:
        """Add the vectors to the sums and counts of their clusters: counts of codes times entries."""
        k = len(counts)
        for c, n in enumerate(np.bincount(cluster, minlength=k).tolist()):
            counts[c] += n
        for b, entries in enumerate(self.blocks):
            times = np.bincount(cluster * len(entries) + self.codes[:, b], minlength=k * len(entries))
            part = times.reshape(k, -1).astype(entries.dtype).dot(entries)
            for c, row in enumerate(part.tolist()):
                for d, value in enumerate(row, b * self.width):
                    sums[c][d] += value


def _limit(dim: int) -> int:
    """Up to this size of a component squared distances and sums of a shard fit 64 bits."""
    return math.isqrt((1 << 62) // dim) // 2


def _centroids(rows: list[list[int]], dim: int) -> np.ndarray:
    large = any(abs(x) > _limit(dim) for row in rows for x in row)
    return np.array(rows, object if large else np.int64)


def _shards(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[Shard]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield Shard(batch, at, scale, _limit(dim))


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, part) with value = sum of part * LIMB ** place, every part small enough to be added up."""
    place = 0
    while not -LIMB <= value < LIMB:
        value, low = divmod(value, LIMB)
        yield place, low
        place += 1
    yield place, value


def _round(centroids: list[list[int]], dim: int, scale: int):
    """Sums and sizes of the clusters over all shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = _centroids(centroids, dim)
        sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
        for shard in _shards(batches, dim, scale):
            shard.add_sums(shard.distances(points).argmin(1), sums, counts)
        rows = [
            (c, d, place, Decimal(part))
            for c, n in enumerate(counts) if n
            for d, value in [(COUNT, n), *enumerate(sums[c])]
            for place, part in limbs(value)
        ]
        if rows:
            cluster, at, limb, total = zip(*rows)
            yield pa.record_batch({
                "cluster": pa.array(cluster, pa.int32()), "at": pa.array(at, pa.int32()),
                "limb": pa.array(limb, pa.int32()), "total": pa.array(total, pa.decimal128(38, 0)),
            })

    return run


def _assigned(centroids: list[list[int]], dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = _centroids(centroids, dim)
        for shard in _shards(batches, dim, scale):
            all_distances = shard.distances(points)
            cluster = all_distances.argmin(1)
            least = all_distances[np.arange(len(cluster)), cluster].tolist()
            yield pa.record_batch({
                "vec_id": pa.array(shard.ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()),
                "distance": pa.array([Decimal(x) if x < 10**38 else None for x in least], pa.decimal128(38, 0)),
            })

    return run


def _moved(centroids: list[list[int]], sums: DataFrame) -> list[list[int]]:
    """Centroids after a round, from one row per cluster and component; an empty cluster keeps its own."""
    totals: dict[tuple[int, int], int] = {}
    for row in sums.groupBy("cluster", "at", "limb").agg(F.sum("total").alias("total")).collect():
        key = (row["cluster"], row["at"])
        totals[key] = totals.get(key, 0) + int(row["total"]) * LIMB ** row["limb"]
    return [
        [totals[c, d] // totals[c, COUNT] for d in range(len(old))] if (c, COUNT) in totals else old
        for c, old in enumerate(centroids)
    ]


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:",
    id_col: str = "vec_id", vector_col: str = "embedding", shard_values: int = SHARD_VALUES,
) -> tuple[DataFrame, list[list[int]]]:
    """Lloyd's rounds from ``k`` vectors chosen by hash: (vec_id, cluster, distance), and the centroids.

    Components become floor(scale * component). Centroids start as the vectors
    with the smallest SHA-256 of ``seed`` and id; every round moves each
    non-empty one to the floor of its vectors' mean; ties go to the smaller
    number. All arithmetic is exact, for components of any size.

    Rows without exactly ``dim`` components, or with a null or non-finite one,
    take no part. Repeated rows count as often as they occur; among starts with
    the same id the smaller vector comes first. A vector with a null id is
    clustered but never a start. With fewer than ``k`` vectors there are that
    many centroids, without any vector no rows and no centroids. ``distance`` is
    decimal, and null from 10 ** 38 on. Other columns are ignored.

    What reaches the driver is ``k`` vectors per round, whatever the input.
    """
    spark = vectors.sparkSession
    importable(spark)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(
        (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    )
    chosen = kept.where(F.col("id").isNotNull()).orderBy(
        F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), "v"
    )
    starts = np.array([r["v"] for r in chosen.limit(k).collect()], float).reshape(-1, dim)
    centroids = [[int(x) for x in row] for row in whole(scaled(starts, scale), scale, 0).tolist()] if len(starts) else []
    if not centroids:
        return spark.createDataFrame([], ASSIGNED), []
    shards = work.written(kept.mapInArrow(_packed(dim, scale, shard_values), SHARD), "shards")
    for _ in range(rounds):
        centroids = _moved(centroids, shards.mapInArrow(_round(centroids, dim, scale), SUMS))
    return shards.mapInArrow(_assigned(centroids, dim, scale), ASSIGNED), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster; distances and sums that do not fit 64 bits are null."""
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    rows = work.written(found, "assigned")
    total = lambda: F.when(F.count("distance") == F.count("*"), F.sum("distance")).alias("inertia")
    by_cluster = rows.groupBy("cluster").agg(total()).select("cluster", F.col("inertia").alias("cluster_inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    # Both lookups have a row per centroid.
    lookup = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(by_cluster, "cluster")
    inertia = rows.agg(total()).scalar()
    whole_number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return rows.withColumn("inertia", inertia).join(F.broadcast(lookup), "cluster").select(
        "vec_id", "cluster", whole_number("distance").alias("distance"),
        whole_number("cluster_inertia").alias("cluster_inertia"), whole_number("inertia").alias("inertia"),
        "centroid_sha256",
    )


def _sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The rounds one after another as tables of their own."""
    def nearest(n: int) -> str:
        return f"""near{n} AS MATERIALIZED (
        SELECT place, v, arg_min(cluster, row(distance, cluster)) AS cluster, min(distance) AS distance FROM (
            SELECT place, v, cluster,
                   CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
            FROM kept, centre{n}) GROUP BY place, v)"""

    def moved(n: int) -> str:
        return f"""part{n} AS (
        SELECT cluster, i, sum(x) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{n}) GROUP BY cluster, i),
    centre{n + 1} AS MATERIALIZED (
        SELECT cluster, coalesce(m.c, o.c) AS c FROM centre{n} o LEFT JOIN (
            SELECT cluster, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c
            FROM part{n} GROUP BY cluster) m USING (cluster))"""

    steps = ",\n    ".join(f"{nearest(n)},\n    {moved(n)}" for n in range(rounds))
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS place, vec_id,
               list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), centre0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c
        FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k}
    ), {steps},
    {nearest(rounds)}
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM near{rounds} JOIN kept USING (place) JOIN centre{rounds} USING (cluster)
    """


QUERIES = {"op12_centroids": op12_centroids}
SQL = {"op12_centroids": _sql()}
