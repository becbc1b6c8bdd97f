"""The prefix tree of conversations against a walk over all prefixes."""

import hashlib
import zlib

import duckdb
import pytest
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from storeflow.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, hi string, part int"


def ordered(rows):
    """Turns (role, text) of every conversation in order."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        convs.setdefault(conv, []).append(((turn is not None, turn or 0, code), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in convs.items() if c is not None}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for node, mine in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((
            min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(children), leaves, saved,
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for n, t in frame.dtypes if n in names[:-1])
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, scale):
    folder = str(TESTDATA / scale)
    frame = T.op11_conversation_trie(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    found = con.execute(T.SQL["op11_conversation_trie"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    expected = sorted((tuple(r) for r in found.fetchall()), key=str)
    assert sorted((tuple(r) for r in frame.select(names).collect()), key=str) == expected


def odd_rows():
    rows = [
        (100, None, None, None), (100, 2, "user", "é" * 3), (100, 1, "user", "hi"), (100, 1, "user", "hi"),
        (101, 1, "user", "hi"), (101, 1, "bot", "hi"), (102, 1, None, ""), (None, 1, "user", "lost"),
        (205, 1, "user", "no source"), (-7, 1, "user", "negative"), (7, 3, "a", "bc"), (8, 3, "ab", "c"),
    ]
    # Conversation 300 and its copies, some shorter: shared prefixes, equal ends, hot nodes.
    for c in range(300, 340):
        rows += [(c, t, "user" if t % 2 else "bot", f"line {t}") for t in range(1, 4 + c % 5)]
    return rows


def test_rebuilt_conversations(spark, tmp_path):
    rows = odd_rows()
    conversations(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = result(T.op11_conversation_trie(spark, str(tmp_path)))
    assert got == brute(rebuilt(ordered(rows)))


def test_plain_conversations(spark):
    rows = odd_rows()
    assert result(T.prefix_tree(conversations(spark, rows))) == brute(ordered(rows))


def test_long_conversations_cross_parts_and_pieces(spark):
    """Most turns belong to two conversations that share 700 turns; parts and pieces cut both."""
    rows = [(c, t, "user", f"t{t}" if t < 700 else f"c{c} t{t}") for c in (1, 2) for t in range(720 + c)]
    rows += [(3, t, "user", f"t{t}") for t in range(500)] + [(4, 0, "user", "other")]
    frame = conversations(spark, rows).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = T.numbered_turns(T._turns(frame))
        assert numbered.count() == len(rows) and numbered.agg({"pos": "max"}).first()[0] == 722
        got = result(T.prefix_tree(frame))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1 + 700 + 21 + 22 + 1
    by_depth = {(r[1], r[0]): r for r in got}
    assert by_depth[500, 1][3:6] == (3, 1, 2) and by_depth[700, 1][3:6] == (2, 2, 2)
    assert by_depth[701, 2][2] == 1 and by_depth[702, 2][2] == 2
    assert by_depth[0, 1][4:6] == (2, 3)
    shared = sum(len(f"t{t}") * ((3 if t < 500 else 2) - 1) for t in range(700))
    assert by_depth[0, 1][6] == shared


def test_empty_table(spark):
    assert T.prefix_tree(conversations(spark, [])).collect() == []


def test_small_blocks_give_the_same_tree(spark):
    paths = T.plain_paths(T._turns(conversations(spark, odd_rows())))
    one, many = T.merged_nodes(paths), T.merged_nodes(paths, 16)
    assert sorted(one.collect()) == sorted(many.select(one.columns).collect())


def test_member_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 10)
    rows = [(1, 2, c) for c in range(50)] + [(1, 3, 7), (0, 0, -5)]
    got = T.member_digests(spark.createDataFrame(rows, "hi long, lo long, conv long")).collect()
    assert {(r.hi, r.lo): r.ends_sha256 for r in got} == {
        (1, 2): hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest(),
        (1, 3): hashlib.sha256(b"7").hexdigest(), (0, 0): hashlib.sha256(b"-5").hexdigest(),
    }


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert T.fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=12), min_size=1, max_size=20))
def test_trie_against_all_prefixes(paths):
    trie = T.Trie()
    for name, path in enumerate(paths):
        keys = [tuple(path[: i + 1]) for i in range(len(path))]
        trie.insert(keys, 0, name)
    prefixes = {tuple(p[:i]) for p in paths for i in range(1, len(p) + 1)}
    expanded = [trie._prefix(n, d) for n in range(len(trie.path)) for d in range(trie.top[n] + 1, trie.depth[n] + 1)]
    assert sorted(expanded) == sorted(prefixes)
    for name, path in enumerate(paths):
        node = next(n for n, e in enumerate(trie.ends) if name in e)
        assert trie._prefix(node, trie.depth[node]) == tuple(path)
        keys = [tuple(path[: i + 1]) for i in range(len(path))]
        assert trie.deepest(keys, 0) == (node, len(path))
    for node, up in enumerate(trie.parent):
        assert trie.top[node] == (trie.depth[up] if up >= 0 else 0)
        assert trie.handles[trie._prefix(node, T.fattest(trie.top[node], trie.depth[node]))] == node
