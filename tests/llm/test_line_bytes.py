"""What a line costs: shingles found by byte and not by counting or matching, parts compared once."""

import random

from pyspark.sql import functions as F

from storeflow.llm import lines as L


def shingle_set(line):
    return {line[i : i + L.WIDTH] for i in range(len(line))}


def test_sets_of_all_scripts_without_matching(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choices("ab é中😀", k=n)) + "." for n in range(1, 80)] + ["abc" * 400, "é" * 100, "中😀" * 70]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    bitmaps = L._bitmaps(rows)
    got = {r.id: r for r in bitmaps.collect()}
    hashes = {r.id: r.h for r in rows.select("id", L._hashes(F.col("text")).alias("h")).collect()}
    for n, line in enumerate(lines):
        assert got[n].n == len(shingle_set(line)) == len(hashes[n])
        words = [0] * L.WORDS
        for h in hashes[n]:
            words[h >> 6 & L.WORDS - 1] |= 1 << (h & 63)
        assert [got[n][f"w{w}"] % (1 << 64) for w in range(L.WORDS)] == words
    signed = L._minhashes(rows.select(F.col("id").alias("line_id"), F.col("text").alias("line")))
    for frame in (bitmaps, signed, rows.select(L._hashes(F.col("text")))):
        assert "regexp_extract_all" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_part_that_is_met_is_not_compared_again(spark):
    """Lines 1 and 2 share a part; line 3 is similar to line 1, so comparing it with line 2 as well gives nothing."""
    none = F.array().cast("array<bigint>")
    lines = [F.struct(F.lit(root).cast("long").alias("root"), F.struct(none.alias("set"), F.lit(n).alias("n")).alias("line"))
             for n, root in ((1, 1), (2, 1), (3, 2), (4, 5))]
    again = F.raise_error(F.lit("compared again")).cast("boolean")

    def similar(x, y, x_set, y_set):
        return F.when((x["n"] == 2) & (y["n"] == 3), again).otherwise((x["n"] == 1) & (y["n"] == 3))

    one = spark.range(1).select(F.array(*lines).alias("all"))
    links = one.select(F.explode(L._forest(F.col("all"), similar)).alias("l")).select("l.*").collect()
    assert [(r.a, r.b) for r in links] == [(1, 2)]
