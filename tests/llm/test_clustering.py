"""Clusters of vectors against plain whole numbers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from conftest import TESTDATA

from storeflow.llm import clustering as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def brute(rows, k, rounds, dim, scale=1024, seed="3:"):
    kept = [
        (i, [math.floor(x * scale) if abs(x) < 2**900 else int(x) * scale for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [
            [sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)
        ]
    found = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept] if centres else []
    return sorted(found, key=str), centres


def clustered(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    found, centres = C.cluster_vectors(frame, **options)
    got = [(r.vec_id, r.cluster, None if r.distance is None else int(r.distance)) for r in found.collect()]
    return sorted(got, key=str), centres


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, scale):
    folder = str(TESTDATA / scale)
    frame = C.op12_centroids(spark, folder)
    types = dict(frame.dtypes)
    assert types["cluster"] == "int" and {types[n] for n in ("vec_id", "distance", "cluster_inertia", "inertia")} == {"bigint"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = con.execute(C.SQL["op12_centroids"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(names).collect())) == sorted(map(tuple, found.fetchall()))


def rows_with_copies():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) / 4).tolist()) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(200, 260)]  # a third are copies
    return rows + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, [-0.0] * 8), (301, [0.0] * 8)]


@pytest.mark.parametrize("shard", [8, 80, C.SHARD_VALUES])
def test_shards_do_not_matter(spark, shard):
    rows = rows_with_copies()
    assert clustered(spark, rows, k=5, rounds=4, dim=8, shard_values=shard) == brute(rows, 5, 4, 8)


def test_rows_that_take_no_part(spark):
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0])]
    bad = [(3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [1.0, 2.0, 3.0])]
    got = clustered(spark, good + bad, k=8, rounds=3, dim=2)
    assert got == brute(good, 8, 3, 2) and len(got[1]) == 2
    assert clustered(spark, bad, dim=2) == ([], [])
    assert clustered(spark, []) == ([], [])


def test_components_of_any_size_are_exact(spark):
    rows = [(1, [1e17, 3.0]), (2, [1e17 + 64, 2.0]), (3, [-3e38, 0.5]), (4, [5.0, 1e300]), (5, [1.7e308, -1.7e308]), (6, [0.1, 0.2])]
    got, centres = clustered(spark, rows, k=3, rounds=4, dim=2)
    expected, wanted = brute(rows, 3, 4, 2)
    assert centres == wanted
    assert got == [(i, c, d if d < 10**38 else None) for i, c, d in expected]


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)]) for i in range(10)]
    got = clustered(spark, rows, k=4, rounds=2, dim=1)
    assert got == brute(rows, 4, 2, 1)


def test_query_totals_and_digests(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(40)] + [(99, [0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    expected, centres = brute(rows, 8, 10, 64)
    got = {r.vec_id: r for r in C.op12_centroids(spark, str(tmp_path)).collect()}
    assert len(got) == 40
    for name, cluster, distance in expected:
        r = got[name]
        assert (r.cluster, r.distance, r.inertia) == (cluster, distance, sum(e[2] for e in expected))
        assert r.cluster_inertia == sum(e[2] for e in expected if e[1] == cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[cluster])).encode()).hexdigest()


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 3, (50, 12)), np.repeat(rng.normal(size=(2, 16)), 40, 0), rng.normal(size=(30, 7))):
        values = values.astype(float)
        width, sizes, entries, codes = C.encoded(values)
        ends = np.cumsum([0, *sizes]) * width
        parts = [entries[a:b].reshape(-1, width)[codes[:, n]] for n, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
        assert (np.concatenate(parts, 1) == values).all()
    assert C.encoded(np.repeat(rng.normal(size=(2, 16)), 40, 0))[0] == 16


def test_parts_of_large_sums():
    for value in (0, -1, C.LIMB - 1, C.LIMB, -C.LIMB - 1, 10**80, -(10**80) + 7):
        assert sum(part * C.LIMB**place for place, part in C.limbs(value)) == value
