"""Fingerprints: equal texts, edits, neighbours in order."""

import hashlib
import random

import pytest
from conftest import TESTDATA

from storeflow.llm import fingerprints as P

SCHEMA = "doc_id long, text string, fingerprint string, part int"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def plain_common(a, b):
    a, b = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_fingerprint(text):
    """The same, byte by byte."""
    data = text.encode()
    size = 4
    while size * P.CHUNKS < len(data):
        size *= 2
    out = []
    for block in (size, 2 * size):
        chunks, total, mask = [], 0, (1 << 64) - 1
        for i in range(len(data)):
            window = data[max(0, i - 7) : i + 1]
            h = int.from_bytes(bytes(8 - len(window)) + window, "little") * int(P.MIX[0]) & mask
            h ^= h >> 32
            h = h * int(P.MIX[1]) & mask
            h ^= h >> 29
            total = (total + h) & mask
            if h % block == 0 or i == len(data) - 1:
                total = total * int(P.MIX[2]) & mask
                total ^= total >> 31
                code = P.CODES[(total * int(P.MIX[0]) & mask) >> 52]
                if chunks.count(code) < 3:
                    chunks.append(code)
                total = 0
        out.append("".join(chunks))
    return f"{size}:{out[0]}:{out[1]}"


@pytest.mark.parametrize("text", ["", "a", "ab cd", "é中文" * 30, "x" * 1000, words(1, 700), "same line\n" * 90])
def test_fingerprint_byte_by_byte(text):
    assert P.fingerprint(text) == plain_fingerprint(text)


def test_common_chunks_against_a_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices(P.CODES[:6], k=rng.randint(0, 70))) for _ in range(2))
        assert P._common(a, b) == plain_common(a, b)


def test_likeness():
    text = words(2, 900)
    mark = P.fingerprint(text)
    assert P.likeness(mark, mark) == 1 and P.likeness(P.fingerprint(""), P.fingerprint("")) == 1
    assert P.likeness(mark, P.fingerprint("")) == 0
    assert P.likeness(mark, P.fingerprint(words(3, 900))) < 0.1
    small = P.fingerprint("new words in front " + text[:3000] + text[3010:])
    assert 0.9 < P.likeness(mark, small) < 1 and P.likeness(mark, small) == P.likeness(small, mark)
    # The first half alone has half the block size.
    assert 0.5 < P.likeness(mark, P.fingerprint(text[: len(text) // 2])) < 0.8
    assert P.likeness(mark, P.fingerprint(text * 5)) == 0


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def test_fingerprints_of_a_table(spark):
    rows = [(1, "a text"), (2, None), (None, "a text"), (1, "a text"), (3, ""), (4, words(5, 30_000))]
    got = P.fingerprints(documents(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(
        str((i, len(t or ""), P.fingerprint(t or ""))).replace("(", "Row(id=", 1).replace(", ", ", n_chars=", 1).replace(", '", ", fingerprint='")
        for i, t in rows
    )


def test_likenesses_of_pairs(spark):
    a, b = P.fingerprint(words(1, 90)), P.fingerprint(words(1, 80))
    pairs = spark.createDataFrame([(a, b), (a, a), (a, None)], "x string, y string")
    assert [r.likeness for r in P.likenesses(pairs, "x", "y").collect()] == [P.likeness(a, b), 1.0, None]
    with pytest.raises(ValueError):
        P.likenesses(pairs, "x", "y", "x")


def brute(rows):
    """Neighbours of rows whose ids differ."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for n, (name, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [P.fingerprint(t) for t in (text, edited, following)]
        out.append((
            name, len(text), hashlib.sha256(edited.encode()).hexdigest(), *marks[:2],
            P.likeness(*marks[:2]), P.likeness(marks[0], marks[2]),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_neighbours_over_all_parts(spark, coalesce):
    rows = [(i * 7 % 101, words(i, i % 40) if i % 9 else None) for i in range(101)] + [(None, "é中" * 11)]
    frame = documents(spark, rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = sorted((tuple(r) for r in P.edited_neighbours(frame).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_few_rows_and_repeated_ones(spark):
    assert P.edited_neighbours(documents(spark, [])).collect() == []
    one = P.edited_neighbours(documents(spark, [(5, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1
    same = [(1, "abcdefgh")] * 30 + [(2, "zz")]
    got = P.edited_neighbours(documents(spark, same)).collect()
    assert len(got) == 31 and sum(r.near_next == 1 for r in got) == 29


def test_query_over_the_table(spark):
    folder = str(TESTDATA / "sf0.001")
    frame = P.op13_fingerprints(spark, folder)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert [t for _, t in frame.dtypes] == ["bigint", "bigint", "string", "string", "string", "double", "double"]
    got = sorted((tuple(r) for r in frame.collect()), key=str)
    assert got == brute(rows)
    edits, others = sorted(r[5] for r in got), sorted(r[6] for r in got)
    assert edits[len(edits) // 20] > others[-len(others) // 10]
