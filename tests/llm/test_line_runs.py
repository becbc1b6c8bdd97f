"""Minhashes of lines that end at every place of a run or a stretch, and pairs that the first words of a bitmap judge."""

import random

from pyspark.sql import functions as F

from storeflow.llm import lines as L


def shingle_set(line):
    return {line[i : i + L.WIDTH] for i in range(len(line))}


def test_lines_of_every_length(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("ab é中😀", k=n)) + "." for n in range(3 * L.STRETCH)]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = {r.line_id: list(r)[1:] for r in L._minhashes(rows).collect()}
    hashes = {r.line_id: r.h for r in rows.select("line_id", L._hashes(F.col("line")).alias("h")).collect()}
    assert L.STRETCH % L.RUN == 0
    assert got == {n: [min(h ^ order for h in hashes[n]) for order in L._orders()] for n in range(len(lines))}
    # As rows, shingles are fewer than characters.
    plan = L._minhashes(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Some({L.RUN})" in plan and L.RUN > 1


def test_similar_by_words_as_by_sets(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choices("abcdefgh ", k=90))]
    for _ in range(39):
        line = list(rng.choice(lines))
        line[rng.randrange(len(line))] = rng.choice("xyz")
        lines.append("".join(line))
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    bits = [f"w{w}" for w in range(L.WORDS)]
    full = rows.join(L._bitmaps(rows), "id").select("id", F.struct("n", *bits, L._hashes(F.col("text")).alias("set")).alias("x"))
    other = full.select(F.col("id").alias("b"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    both = full.crossJoin(other).where("id < b").where(L._similar(L.PERCENT)(x, y, x["set"], y["set"]))
    sets = [shingle_set(t) for t in lines]
    wanted = {(a, b) for b in range(40) for a in range(b) if 100 * len(sets[a] & sets[b]) >= L.PERCENT * len(sets[a] | sets[b])}
    assert wanted and {(r.id, r.b) for r in both.select("id", "b").collect()} == wanted
