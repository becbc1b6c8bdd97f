"""Nodes of two members below a branching: nothing has compared them before, so they are open."""

from pyspark.sql import functions as F

from storeflow.llm import work


def test_children_of_two_are_compared(spark):
    """One node of ten branches into five of two: each pair is linked, none by luck of the pivot."""
    members = spark.createDataFrame([(0, n) for n in range(10)], "node long, id long")

    def check(pairs):
        return pairs.where(F.floor(F.col("a") / 2) == F.floor(F.col("b") / 2))

    def compare(rows):
        other = rows.select("node", F.col("id").alias("b"), F.col("root").alias("other"))
        pairs = rows.join(other, "node").where("id < b and root != other")
        return check(pairs.select(F.col("id").alias("a"), "b"))

    def branch(rows, state):
        return rows.select(F.floor(F.col("id") / 2).alias("node"), "id"), check, state

    links = work.connect(members, check, compare, 4, branch, 3)
    parts = {}
    for r in work.components(links).collect():
        parts.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [[n, n + 1] for n in range(0, 10, 2)]
