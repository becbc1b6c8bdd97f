"""Working tables in the shared folder, which all executors reach, and components of a link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeflow.session import fresh_path


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches.

    Alternating large and small stars: every node sends its larger neighbours,
    then its smaller ones and itself, to the smallest of its neighbourhood,
    until nothing changes. A hub is an aggregate and a join, never one list.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.join(least, "a")
        if larger:
            moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where(F.col("a") != F.col("b")).distinct()

    def unsettled(edges: DataFrame) -> bool:
        """Whether a node points to two others, or to one that points on."""
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        on = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi")
        return not twice.unionAll(on).isEmpty()

    edges = written(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    while unsettled(edges):
        edges = written(star(star(edges, True), False), "links")
    # A star: every node that is not a root points to its root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def settled(
    members: DataFrame, links: DataFrame, check: Callable[[DataFrame], DataFrame], least: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare the smallest member of every node of ``members`` (node, id) with all others.

    Nodes of up to ``least`` members are not compared, only placed by the links;
    so one of two members is open like any other, where a compared one is done.

    Returns the links found; the members with the root that all links give them,
    and whether that is another than the smallest member's; and the nodes (node,
    n, outside, same: equal for equal members) in which some member is outside
    its component, so that pairs are still open.
    """
    pivots = members.groupBy("node").agg(F.min("id").alias("pivot"), F.count("*").alias("size"))
    stars = members.join(pivots.where(F.col("size") > least), "node").where(F.col("id") != F.col("pivot"))
    found = written(check(stars.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()), "verified")
    roots = written(components(links.unionAll(found)), "roots")
    placed = (
        members.join(pivots, "node")
        .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("main")), "pivot", "left")
        .select(
            "node", "id", F.coalesce("root", "id").alias("root"),
            (F.coalesce("root", "id") != F.coalesce("main", "pivot")).alias("outside"),
        )
    )
    placed = written(placed, "placed")
    nodes = placed.groupBy("node").agg(
        F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("outside"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same"),
    ).where((F.col("outside") > 0) & ((F.col("n") > 2) | (F.col("n") <= least)))
    return found, placed, written(nodes, "nodes")


def dealt(placed: DataFrame, nodes: DataFrame, leaf: int) -> DataFrame:
    """(node, id, root): every open pair of ``nodes`` (node, n, outside) meets in a node of about ``leaf`` members.

    The members outside the pivot's component and those inside it are dealt to
    blocks of half that size. A block outside meets every other block; two blocks
    inside never meet, as their members are connected.
    """
    size = F.lit(max(1, leaf // 2))
    far, near = F.ceil(F.col("outside_n") / size), F.ceil((F.col("n") - F.col("outside_n")) / size)
    salt = F.xxhash64("id", F.lit(leaf))
    mine = F.when(F.col("outside"), F.pmod(salt, far)).otherwise(far + F.pmod(salt, near))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("outside"), far + near).otherwise(far) - 1)
    return (
        placed.join(nodes.select("node", "n", F.col("outside").alias("outside_n")), "node")
        .select("node", "id", "root", mine.alias("mine"), F.explode(F.array_remove(others, mine)).alias("other"))
        .select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "id", "root")
    )


def shared(members: DataFrame) -> DataFrame:
    """The rows (node, id) of nodes with two members or more."""
    return written(members.join(members.groupBy("node").count().where("count > 1").select("node"), "node"), "members")


def connect(
    members: DataFrame, check: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], leaf: int,
    branch: Callable[[DataFrame, object], tuple[DataFrame, Callable, object]] | None = None, depth: int = 0,
) -> DataFrame:
    """Links (a, b) that connect what all similar pairs within the nodes of ``members`` (node, id) would connect.

    ``check`` keeps the similar ones of pairs (a, b). Nodes whose members turn
    out to be connected are done. All others go to ``compare`` as rows (node, id,
    root, block), which returns links between different roots: those of up to
    ``leaf`` members whole, larger ones in pairs of blocks, so that no pair is left out.

    With ``branch``, larger nodes branch: it takes their members (node, id) and
    its own state of the level before, and returns the members of child nodes, a
    check for pairs of these and its new state. Children replace the larger nodes,
    up to ``depth`` times, as long as that leaves a quarter of the open pairs or
    fewer: members that are not similar part quickly, and for others blocks are
    the cheaper way.
    """

    def large(nodes: DataFrame) -> tuple[DataFrame, float]:
        """The nodes above ``leaf`` and their open pairs, added."""
        rows = nodes.where(F.col("n") > leaf)
        return rows, rows.agg(F.sum(F.col("n").cast("double") * F.col("outside"))).first()[0] or 0.0

    def small(placed: DataFrame, nodes: DataFrame) -> DataFrame:
        return placed.join(nodes.where(F.col("n") <= leaf).select("node", "n", "same"), "node")

    found = members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    links, placed, nodes = settled(members, found, check)
    whole = small(placed, nodes)
    nodes, pairs = large(nodes)
    state = None
    while branch and depth and pairs:
        open_members = placed.join(nodes.select("node"), "node").select("node", "id")
        children, check, state = branch(open_members, state)
        more, below, parts = settled(shared(children), links, check, leaf)
        links, depth = links.unionAll(more), depth - 1
        rest, less = large(parts)
        if 4 * less > pairs:
            break
        whole = whole.unionAll(small(below, parts))
        placed, nodes, pairs = below, rest, less
    # Equal members need one comparison, whatever their number of nodes.
    once = whole.select("node", "n", "same").distinct().dropDuplicates(["n", "same"]).select("node")
    whole = whole.join(once, "node").select("node", "id", "root")
    pairs = dealt(placed, nodes.dropDuplicates(["n", "same"]), leaf)
    rows = whole.withColumn("block", F.lit(False)).unionAll(pairs.withColumn("block", F.lit(True)))
    return links.unionAll(written(compare(rows), "compared"))
