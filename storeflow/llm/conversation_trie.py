"""A prefix tree of conversations, built from z-fast tries.

Every prefix of a conversation has a hash of 124 bits that follows from running
sums over its turns, so that prefixes are compared without their texts. Pieces
of conversations are dealt to blocks of bounded size. In a block they go into a
compacted trie: a node is found under the hash of its handle, the prefix whose
depth is the two-fattest number on the node's edge, and a piece finds the node
where it leaves the trie by fat binary search over its depths. The edges are then
expanded to one row for every depth, and equal prefixes of all blocks are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storeflow.llm import work
from storeflow.llm.tables import importable, table

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_031, 1_812_433_253, 1_566_083_941)
HASHES = range(len(BASES))
PIECE = 256  # turns of a conversation that go to one block together
BLOCK_TURNS = 65_536
CHUNK = 1 << 20  # characters of a list of members that travel in one row
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

G, TERM = [f"g{j}" for j in HASHES], [f"w{j}" for j in HASHES]
PLACED = ", ".join(["part int", "conv long", "at long", "size long", "tokens long", *[f"{n} long" for n in (*G, *TERM)]])
NODE = "hi long, lo long, phi long, plo long, depth long, size long, before long, n long, least long, total long"


# --- turns in order, with running sums --------------------------------------------------------

def powers(base: int, first: int, count: int) -> np.ndarray:
    """base ** (first + i) modulo PRIME for i below ``count``, by doubling."""
    out = np.array([pow(base, first, PRIME)], np.int64)
    while len(out) < count:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[:count]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a part in order: their place in the conversation's run, and sums over the run so far."""
    part = TaskContext.get().partitionId()
    last, place, tokens, sums = None, 0, 0, [0] * len(BASES)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(n, 8)[:, : len(BASES)]
        size = batch.column("size").to_numpy()
        new = np.append(True, conv[1:] != conv[:-1])
        if conv[0] != last:
            place, tokens, sums = 0, 0, [0] * len(BASES)
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        at = np.arange(n) - starts[run] + 1
        longest = int(at.max())
        carried = run == 0
        out = {"part": np.full(n, part, np.int32), "conv": conv, "at": at + place * carried, "size": size}
        running = np.cumsum(size)
        out["tokens"] = running - (running - size)[starts][run] + tokens * carried
        for j, base in enumerate(BASES):
            term = digest[:, j].astype(np.int64) % PRIME
            grown = powers(base, 1, longest)[at - 1]
            if place:
                grown = np.where(carried, grown * pow(base, place, PRIME) % PRIME, grown)
            term = term * grown % PRIME
            running = np.cumsum(term)
            out[G[j]] = (running - (running - term)[starts][run] + sums[j] * carried) % PRIME
            out[TERM[j]] = term
        last, place, tokens = conv[-1], int(out["at"][-1]), int(out["tokens"][-1])
        sums = [int(out[g][-1]) for g in G]
        names = ["part", "conv", "at", "size", "tokens", *G, *TERM]
        yield pa.record_batch([pa.array(out[name]) for name in names], names=names)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, size, tokens, g0.., w0..) of turns (conv, turn, role, text), written.

    ``pos`` counts the turns of a conversation from 1, ``tokens`` adds up their
    code points, ``g`` their hash terms ``w``. A range exchange orders them, so
    a conversation of any length is spread over parts; sums are carried over
    where it crosses from one part to the next, one small row per part.
    """
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    order = ["conv", "turn", "digest", "row"]
    rows = turns.where(F.col("conv").isNotNull()).select(
        "conv", "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "size")
    placed = work.written(ordered.mapInArrow(_placed, PLACED), "placed")
    ends = placed.groupBy("conv", "part").agg(
        F.max_by(F.struct("at", "tokens", *G), "at").alias("end"),
        F.count("*").alias("n"),
    )
    crossing = ends.withColumn("parts", F.count("*").over(W.partitionBy("conv"))).where("parts > 1")
    carried = []
    conv, place, tokens, sums = None, 0, 0, [0] * len(BASES)
    # At most two rows for each part.
    for row in crossing.select("conv", "part", "end").orderBy("conv", "part").collect():
        if row["conv"] != conv:
            conv, place, tokens, sums = row["conv"], 0, 0, [0] * len(BASES)
        else:
            carried.append((conv, row["part"], place, tokens, *sums, *[pow(b, place, PRIME) for b in BASES]))
        end = row["end"]
        sums = [(s + pow(b, place, PRIME) * end[g]) % PRIME for s, b, g in zip(sums, BASES, G)]
        place, tokens = place + end["at"], tokens + end["tokens"]
    if not carried:
        return placed.select("conv", F.col("at").alias("pos"), "size", "tokens", *G, *TERM)
    names = ", ".join([*[f"c{j} long" for j in HASHES], *[f"m{j} long" for j in HASHES]])
    carry = spark.createDataFrame(carried, f"conv long, part int, c_at long, c_tokens long, {names}")
    joined = placed.join(F.broadcast(carry), ["conv", "part"], "left").na.fill(0, ["c_at", "c_tokens"])
    grown = [(F.coalesce(f"m{j}", F.lit(1)) * F.col(G[j]) + F.coalesce(f"c{j}", F.lit(0))) % PRIME for j in HASHES]
    terms = [F.coalesce(f"m{j}", F.lit(1)) * F.col(TERM[j]) % PRIME for j in HASHES]
    return joined.select(
        "conv", (F.col("at") + F.col("c_at")).alias("pos"), "size", (F.col("tokens") + F.col("c_tokens")).alias("tokens"),
        *[c.alias(n) for c, n in zip(grown, G)], *[c.alias(n) for c, n in zip(terms, TERM)],
    )


# --- paths ------------------------------------------------------------------------------------

def _key(hashes: list[Column], high: str, low: str) -> list[Column]:
    """Four hashes of 31 bits as two numbers."""
    return [
        (hashes[0] * (1 << 31) + hashes[1]).alias(high), (hashes[2] * (1 << 31) + hashes[3]).alias(low),
    ]


def _path(depth: Column, hashes: list[Column], terms: list[Column], size: Column, before: Column) -> list[Column]:
    above = [F.pmod(h - w, F.lit(PRIME)) for h, w in zip(hashes, terms)]
    return [
        F.col("conv"), F.col("total"), F.col("length"), depth.cast("long").alias("depth"), *_key(hashes, "hi", "lo"),
        *_key(above, "phi", "plo"), size.alias("size"), before.alias("before"),
    ]


def plain_paths(turns: DataFrame) -> DataFrame:
    """One row for every conversation and depth, from the root at depth 0: the prefix, its parent, its last turn."""
    rows = numbered_turns(turns)
    whole = rows.groupBy("conv").agg(F.max("pos").alias("length"), F.max("tokens").alias("total"))
    below = rows.join(whole, "conv").select(_path(
        F.col("pos"), [F.col(g) for g in G], [F.col(w) for w in TERM], F.col("size"), F.col("tokens") - F.col("size")
    ))
    return _rooted(whole, below)


def _rooted(conversations: DataFrame, below: DataFrame) -> DataFrame:
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    root = conversations.select(
        "conv", "total", "length", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.alias("phi"),
        none.alias("plo"), zero.alias("size"), zero.alias("before"),
    )
    return work.written(root.unionAll(below), "paths")


def rebuilt_paths(turns: DataFrame, every: int, head: Column, most: int) -> DataFrame:
    """:func:`plain_paths` of conversations whose first turns come from another one.

    Conversation c takes the first h turns of c - c % ``every``, or as many as
    that one has, and then its own after its first h, with h the column ``head``
    of ``conv``, from 0 to ``most``.
    """
    rows = work.written(numbered_turns(turns), "turns").withColumn("h", head.cast("long"))
    at_head = F.col("pos") == F.col("h")
    own = rows.groupBy("conv", "h").agg(
        F.max("pos").alias("n"), F.max("tokens").alias("tokens"),
        F.coalesce(F.max(F.when(at_head, F.col("tokens"))), F.lit(0)).alias("own_tokens"),
        *[F.coalesce(F.max(F.when(at_head, F.col(g))), F.lit(0)).alias(f"own_{g}") for g in G],
    ).withColumn("source", F.col("conv") - F.col("conv") % every)
    sources = own.where(F.col("conv") == F.col("source")).select(F.col("conv").alias("source"), F.col("n").alias("source_n"))
    first = rows.where((F.col("pos") <= most) & (F.col("conv") % every == 0)).select(
        F.col("conv").alias("source"), "pos", "size", F.col("tokens").alias("head_tokens"),
        *[F.col(g).alias(f"head_{g}") for g in G], *[F.col(w).alias(f"head_{w}") for w in TERM],
    )
    taken = F.least("h", F.coalesce("source_n", F.lit(0)))
    given = own.join(sources, "source", "left").withColumn("taken", taken).join(
        first.drop("size", *[f"head_{w}" for w in TERM]).withColumnRenamed("pos", "taken"), ["source", "taken"], "left"
    ).na.fill(0, ["head_tokens", *[f"head_{g}" for g in G]])
    # A turn moves up by h - taken places: its hash term is divided by that power of the base.
    up = [F.array(*[F.lit(pow(b, -i, PRIME)) for i in range(most + 1)])[(F.col("h") - F.col("taken")).cast("int")] for b in BASES]
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    members = work.written(given.select(
        "conv", "source", "h", "taken", (F.col("taken") + rest).alias("length"),
        (F.col("head_tokens") + F.when(rest > 0, F.col("tokens") - F.col("own_tokens")).otherwise(0)).alias("total"),
        (F.col("head_tokens") - F.col("own_tokens")).alias("more_tokens"), *[u.alias(f"up{j}") for j, u in enumerate(up)],
        *[F.pmod(F.col(f"head_{g}") - u * F.col(f"own_{g}") % PRIME, F.lit(PRIME)).alias(f"more_{g}") for g, u in zip(G, up)],
    ), "members")
    kept = rows.where(F.col("pos") > F.col("h")).drop("h").join(members, "conv").select(_path(
        F.col("pos") - F.col("h") + F.col("taken"),
        [(F.col(f"up{j}") * F.col(G[j]) + F.col(f"more_{G[j]}")) % PRIME for j in HASHES],
        [F.col(f"up{j}") * F.col(TERM[j]) % PRIME for j in HASHES],
        F.col("size"), F.col("tokens") - F.col("size") + F.col("more_tokens"),
    ))
    moved = members.join(first, "source").where(F.col("pos") <= F.col("taken")).select(_path(
        F.col("pos"), [F.col(f"head_{g}") for g in G], [F.col(f"head_{w}") for w in TERM],
        F.col("size"), F.col("head_tokens") - F.col("size"),
    ))
    return _rooted(members, kept.unionAll(moved))


# --- the trie of a block ----------------------------------------------------------------------

def fattest(low: int, high: int) -> int:
    """The number above ``low`` and up to ``high`` that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Trie:
    """A compacted trie of paths, each given as the hashes of its prefixes at consecutive depths.

    A node is (its path, the depth its edge starts below, the depth it ends at).
    """

    def __init__(self) -> None:
        self.paths: list[tuple[list, int]] = []
        self.path: list[int] = []
        self.top: list[int] = []
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.ends: list[list[int]] = []
        self.handles: dict = {}
        self.below: dict = {}  # by the first prefix of a node's edge

    def _node(self, path: int, top: int, depth: int, parent: int) -> int:
        node = len(self.path)
        for column, value in ((self.path, path), (self.top, top), (self.depth, depth), (self.parent, parent), (self.ends, [])):
            column.append(value)
        self._named(node)
        return node

    def _prefix(self, node: int, depth: int):
        keys, base = self.paths[self.path[node]]
        return keys[depth - base - 1]

    def _named(self, node: int) -> None:
        """Enter the node under its handle and under the first prefix of its edge."""
        self.handles[self._prefix(node, fattest(self.top[node], self.depth[node]))] = node
        self.below[self._prefix(node, self.top[node] + 1)] = node

    def deepest(self, keys: list, base: int) -> tuple[int, int]:
        """Fat binary search: the deepest node whose whole prefix the path has, or -1, and its depth."""
        node, low, high = -1, base, base + len(keys)
        while low < high:
            middle = fattest(low, high)
            found = self.handles.get(keys[middle - base - 1], -1)
            if found < 0:
                high = middle - 1
            elif self.depth[found] <= base + len(keys) and keys[self.depth[found] - base - 1] == self._prefix(found, self.depth[found]):
                node, low = found, self.depth[found]
            else:
                # The path has the node's handle but leaves within its edge: the parent is the deepest.
                return self.parent[found], self.top[found]
        return node, low

    def insert(self, keys: list, base: int, name: int) -> None:
        """Add the path with hashes ``keys`` at the depths base + 1, base + 2, ..."""
        path, end = len(self.paths), base + len(keys)
        self.paths.append((keys, base))
        node, depth = self.deepest(keys, base)
        if depth < end:
            exit_ = self.below.get(keys[depth - base], -1)
            if exit_ < 0:
                node = self._node(path, depth, end, node)
            else:
                # The path leaves within this edge: the last common depth, by halving.
                low, high = depth + 1, min(end, self.depth[exit_])
                while low < high:
                    middle = (low + high + 1) // 2
                    if keys[middle - base - 1] == self._prefix(exit_, middle):
                        low = middle
                    else:
                        high = middle - 1
                del self.handles[self._prefix(exit_, fattest(self.top[exit_], self.depth[exit_]))]
                split = self._node(self.path[exit_], self.top[exit_], low, self.parent[exit_])
                self.top[exit_], self.parent[exit_] = low, split
                self._named(exit_)
                node = split if low == end else self._node(path, low, end, split)
        self.ends[node].append(name)


def _pieces(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """Start and end of every piece in sorted rows: one conversation, consecutive depths."""
    conv, depth = rows.column("conv").to_numpy(), rows.column("depth").to_numpy()
    new = np.append(True, (conv[1:] != conv[:-1]) | (depth[1:] // PIECE != depth[:-1] // PIECE))
    starts = np.flatnonzero(new)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(conv)])


def _block(rows: pa.Table) -> pa.Table:
    """The distinct prefixes of a block with the number, smallest id and tokens of their conversations."""
    rows = rows.sort_by([("conv", "ascending"), ("depth", "ascending")]).combine_chunks()
    keys = [a << 62 | b for a, b in zip(rows.column("hi").to_pylist(), rows.column("lo").to_pylist())]
    conv, total = rows.column("conv").to_pylist(), rows.column("total").to_pylist()
    depth = rows.column("depth").to_pylist()
    trie = Trie()
    first_row = []
    for a, b in _pieces(rows):
        first_row.append(a)
        trie.insert(keys[a:b], depth[a], a)  # a level is one more than a depth: the root is level 1
    n = [len(e) for e in trie.ends]
    least = [min((conv[r] for r in e), default=None) for e in trie.ends]
    tokens = [sum(total[r] for r in e) for e in trie.ends]
    for node in sorted(range(len(n)), key=trie.depth.__getitem__, reverse=True):
        up = trie.parent[node]
        if up >= 0:
            n[up] += n[node]
            tokens[up] += tokens[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
    # An edge has a row for each of its depths, all with the members of the node at its end.
    spans = [trie.depth[i] - trie.top[i] for i in range(len(n))]
    start = [first_row[trie.path[i]] + trie.top[i] - trie.paths[trie.path[i]][1] for i in range(len(n))]
    owner = np.repeat(np.arange(len(n)), spans)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    out = rows.take(pa.array(np.array(start, np.int64)[owner] + offset, pa.int64()))
    out = out.select(["hi", "lo", "phi", "plo", "depth", "size", "before"])
    for name, values in (("n", n), ("least", least), ("total", tokens)):
        out = out.append_column(name, pa.array(np.array(values, np.int64)[owner], pa.int64()))
    return out


def merged_nodes(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix, from the tries of all blocks."""
    many = paths.agg(F.ceil(F.count("*") / block_turns).alias("n")).scalar()
    block = F.pmod(F.xxhash64("conv", F.floor(F.col("depth") / PIECE)), F.greatest(many, F.lit(1)))
    parts = paths.drop("length").withColumn("block", block).groupBy("block").applyInArrow(_block, NODE)
    same = [F.first(n).alias(n) for n in ("phi", "plo", "depth", "size", "before")]
    return parts.groupBy("hi", "lo").agg(
        *same, F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total")
    )


# --- members that end at a node ---------------------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (hi, lo, conv) to texts of joined ids, of a bounded length each."""
    node, first, held, length = None, 0, [], 0
    for batch in batches:
        out = []
        for hi, lo, conv in zip(*(batch.column(n).to_pylist() for n in ("hi", "lo", "conv"))):
            if (hi, lo) != node or length >= CHUNK:
                if held:
                    out.append((*node, first, ",".join(held)))
                node, first, held, length = (hi, lo), conv, [], 0
            held.append(str(conv))
            length += len(held[-1]) + 1
        if out:
            yield _rows(out)
    if held:
        yield _rows([(*node, first, ",".join(held))])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    hi, lo, first, text = zip(*out)
    return pa.record_batch({
        "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "first": pa.array(first, pa.int64()),
        "ids": pa.array(text, pa.string()),
    })


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks (hi, lo, first, ids) to one digest per node; a list is streamed, never held."""
    node, digest = None, None
    for batch in batches:
        out = []
        for hi, lo, ids in zip(*(batch.column(n).to_pylist() for n in ("hi", "lo", "ids"))):
            if (hi, lo) == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = (hi, lo), hashlib.sha256(ids.encode())
        if out:
            yield _digest_rows(out)
    if node:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(out: list[tuple]) -> pa.RecordBatch:
    hi, lo, digest = zip(*out)
    return pa.record_batch({
        "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "ends_sha256": pa.array(digest, pa.string()),
    })


def member_digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of rows (hi, lo, conv): SHA-256 of each node's ids, ascending, joined by commas.

    The ids of a node are sorted over all parts and joined to chunks; a task
    reads the few chunks of a node in order, however many members it has.
    """
    order = ["hi", "lo", "conv"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _chunks, "hi long, lo long, first long, ids string"
    )
    return chunks.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(
        _digests, "hi long, lo long, ends_sha256 string"
    )


# --- the tree ---------------------------------------------------------------------------------

def tree(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every distinct prefix of ``paths`` as a node with its place in the tree and sums over its subtree.

    Columns: hi, lo (the prefix), conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Sums over a subtree need no walk. A node is owned by its smallest member,
    and the nodes that a member owns are the last ones of its path; so what is
    counted once per node below u is the sum of what u's members own, less what
    its own smallest member owns above u.
    """
    nodes = work.written(merged_nodes(paths, block_turns), "nodes")
    children = nodes.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count("*").alias("n_children"))
    shaped = work.written(nodes.join(children, ["hi", "lo"], "left").na.fill(0, ["n_children"]), "shaped")
    owned = work.written(shaped.groupBy(F.col("least").alias("conv")).agg(
        F.sum("size").alias("owned"), F.min("depth").alias("from_depth"),
        F.max(F.col("before") + F.col("size")).alias("path_total"),
        F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
    ), "owned")
    sums = paths.join(owned, "conv").groupBy("hi", "lo").agg(
        F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves")
    )
    ends = member_digests(paths.where(F.col("depth") == F.col("length")))
    mine = owned.select(F.col("conv").alias("least"), F.col("owned").alias("mine"), "from_depth", "path_total")
    # The first node that a conversation owns hangs below a node of another one; all others below its own.
    hanging = shaped.join(mine.select("least", F.col("from_depth").alias("depth")), ["least", "depth"]).select("hi", "lo", "phi", "plo")
    above = hanging.join(
        nodes.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("least").alias("above")), ["phi", "plo"]
    ).select("hi", "lo", "above")
    # Tokens of the smallest member's path are those above u, and those that it owns at u and below.
    below = F.col("owned") - F.col("mine") + F.col("mine_below")
    return (
        shaped.join(sums, ["hi", "lo"]).join(ends, ["hi", "lo"], "left").join(above, ["hi", "lo"], "left").join(mine, "least")
        .withColumn("mine_below", F.col("path_total") - F.col("before"))
        .select(
            "hi", "lo", F.col("least").alias("conv_id"), "depth",
            F.when(F.col("depth") > 0, F.coalesce("above", "least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            "n_children", "n_leaves", (F.col("total") - F.col("n") * F.col("before") - below).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )


def _turns(conversations: DataFrame) -> DataFrame:
    importable(conversations.sparkSession)
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """The prefix tree of conversations (conv_id, turn, role, text); see :func:`tree` for its columns.

    Turns are ordered by number, null first, and those of the same number by the
    SHA-256 of role and text, so that repeated rows are turns of their own in a
    fixed order. A null role or text counts as empty. Rows without a conversation
    are left out; other columns are ignored; an empty table has no nodes.
    """
    return tree(plain_paths(_turns(conversations)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv").cast("string")) % 6
    return tree(rebuilt_paths(turns, 100, head, 5)).drop("hi", "lo")


_CRC32 = """xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, x: list_reduce(list_prepend(xor(crc, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                   lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""

SQL = {
    "op11_conversation_trie": f"""
    WITH named AS (
        SELECT conv_id AS c, turn, coalesce(text, '') AS text,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code
        FROM conversations WHERE conv_id IS NOT NULL
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) AS pos FROM named
    ), heads AS (
        SELECT c, n, {_CRC32} % 6 AS h, c - c % 100 AS source FROM (SELECT c, count(*) AS n FROM numbered GROUP BY c)
    ), given AS (
        SELECT g.c, g.h, g.source, least(g.h, coalesce(s.n, 0)) AS taken FROM heads g LEFT JOIN heads s ON s.c = g.source
    ), rebuilt AS (
        SELECT g.c, t.pos AS d, code, text FROM given g JOIN numbered t ON t.c = g.source AND t.pos <= g.taken
        UNION ALL
        SELECT g.c, t.pos - g.h + g.taken, code, text FROM given g JOIN numbered t ON t.c = g.c AND t.pos > g.h
    ), paths AS MATERIALIZED (
        SELECT c, d, length(text) AS size, string_agg(code, '/') OVER (PARTITION BY c ORDER BY d) AS prefix FROM rebuilt
        UNION ALL SELECT c, 0, 0, '' FROM heads
    ), nodes AS MATERIALIZED (
        SELECT prefix, d, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
               CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE left(prefix, length(prefix) - 65) END AS parent
        FROM paths GROUP BY prefix, d
    ), children AS MATERIALIZED (
        SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
    ), under AS (
        SELECT DISTINCT a.prefix, b.prefix AS lower_prefix FROM paths a JOIN paths b ON a.c = b.c AND a.d <= b.d
    ), sums AS (
        SELECT u.prefix, CAST(sum((v.n_convs - 1) * v.size) AS BIGINT) AS saved_tokens,
               count(*) FILTER (k.n_children IS NULL) AS n_leaves
        FROM under u JOIN nodes v ON v.prefix = u.lower_prefix LEFT JOIN children k ON k.prefix = v.prefix GROUP BY u.prefix
    ), ends AS (
        SELECT prefix, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
        FROM (SELECT c, prefix, d, max(d) OVER (PARTITION BY c) AS last FROM paths) WHERE d = last GROUP BY prefix
    )
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
           coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
           coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM nodes n JOIN sums USING (prefix) LEFT JOIN nodes p ON p.prefix = n.parent
    LEFT JOIN children k ON k.prefix = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix
    """
}
QUERIES = {"op11_conversation_trie": op11_conversation_trie}
