"""Links of similar lines: no more than join their parts, none lost, any column names."""

import random

from pyspark.sql import functions as F

from storeflow.llm import lines as L


def shingle_set(line):
    return {line[i : i + 12] for i in range(len(line))}


def parts(names, links):
    top = {n: n for n in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[find(b)] = find(a)
    return {n: find(n) for n in names}


def grouped(found):
    out = {}
    for name, part in found.items():
        out.setdefault(part, set()).add(name)
    return sorted(map(sorted, out.values()))


def variants(seed, n, length):
    """Lines of one family, each some steps from another one: chains, so that not all are alike."""
    rng = random.Random(seed)
    lines = ["".join(rng.choices("abcdefgh ", k=length))]
    while len(lines) < n:
        line = list(rng.choice(lines[-4:]))
        line[rng.randrange(length)] = rng.choice("xyz")
        lines.append("".join(line))
    return list(dict.fromkeys(lines))


def similar(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return 100 * len(a & b) >= L.PERCENT * len(a | b)


def test_a_node_gives_a_forest(spark):
    """All lines in one node: as many links as join the parts of the brute-force graph."""
    lines = variants(1, 60, 150) + variants(2, 40, 90) + ["short", "shorter"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "root long, text string")
    bits = [f"w{w}" for w in range(L.WORDS)]
    sketch = L._bitmaps(rows.select(F.col("root").alias("id"), "text")).withColumnRenamed("id", "root")
    line = F.struct(L._hashes(F.col("text")).alias("set"), "n", *bits).alias("line")
    node = rows.join(sketch, "root").agg(F.collect_list(F.struct("root", line)).alias("all"))
    both = L._similar(L.PERCENT)
    links = [(r.a, r.b) for r in node.select(F.explode(L._forest(F.col("all"), both)).alias("l")).select("l.*").collect()]
    names = range(len(lines))
    wanted = [(a, b) for a in names for b in names if a < b and similar(lines[a], lines[b])]
    expected = grouped(parts(names, wanted))
    assert grouped(parts(names, links)) == expected
    assert len(links) == len(lines) - len(expected) and len(wanted) > len(links)


def test_classes_of_a_family_of_a_thousand_lines(spark):
    lines = variants(3, 1000, 160)
    rng = random.Random(9)
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, "\n".join(lines[i::50])) for i in range(50)], "doc_id long, text string")
    got = {r.line_id: r.class_id for r in L.line_classes(docs).collect()}
    ids = {r.line: r.id for r in spark.createDataFrame([(t,) for t in lines], "line string").select("line", F.xxhash64("line").alias("id")).collect()}
    names = [ids[t] for t in lines]
    wanted = [(ids[a], ids[b]) for i, a in enumerate(lines) for b in lines[:i] if similar(a, b)]
    # The links of a chain are found with 0.993 or more each; no two lines of different parts meet.
    expected, found = grouped(parts(names, wanted)), grouped({n: got[n] for n in names})
    assert all(any(set(f) <= set(e) for e in expected) for f in found)
    assert len(found) <= len(expected) + 3


def test_minhashes_of_long_and_short_lines(spark):
    lines = ["a", "twelve chars", "é" * 40, "x y " * 900, "中文字" * 33, "0123456789" * 7]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_id long, line string")
    got = {r.line_id: list(r)[1:] for r in L._minhashes(rows).collect()}
    hashes = {r.line_id: r.h for r in rows.select("line_id", L._hashes(F.col("line")).alias("h")).collect()}
    for i in range(len(lines)):
        assert len(hashes[i]) == len(shingle_set(lines[i]))
        assert got[i] == [min(h ^ order for h in hashes[i]) for order in L._orders()]


def test_columns_with_any_names(spark):
    text = "one line that is long enough to count\nsecond line"
    rows = spark.createDataFrame([(1, text, "i", "t", "g", "r"), (2, text, "i", "t", "g", "r")],
                                 "doc_id long, text string, _id string, _text string, _gone string, row string")
    got = sorted(map(tuple, L.without_repeated_lines(rows).collect()))
    assert got == [(1, text, "i", "t", "g", "r"), (2, "", "i", "t", "g", "r")]
