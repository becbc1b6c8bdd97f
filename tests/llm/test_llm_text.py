"""Text operators against brute force, on small documents with every odd case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeflow.llm import (
    bpe, byte_dedup, decontamination, fm_index, language_model, lines, near, quality, windows, word_dedup,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("kept", T.StringType()),
])


def prose(rng, n, words=400):
    return " ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(n))


def edited(rng, text, rate):
    return " ".join(w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in text.split(" "))


def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (120, 90, 200, 60, 40, 300)]
    out = [*base, *base[:3], None, "", " \t\n ", "one", "ONE", "a b c d", "É é ß 日本語 😀", "x" * 5000]
    out += [edited(rng, base[n % 4], 0.01 * (n % 5)) for n in range(60)]
    out += [base[0] + "\n" + base[5], prose(rng, 30) + " " + base[1] + " " + prose(rng, 20), base[2] * 2]
    out += [prose(rng, 9000, 5000) + " " + base[3]]
    out += ["\n".join([base[3], f"line {n}", "", base[4], edited(rng, base[1], 0.02)]) for n in range(4)]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(n, t) for n, t in enumerate(texts())]
    # A repeated row, a repeated id with another text, and null ids.
    return [*found, found[2], (3, "another text under a repeated id"), (None, found[1][1]), (None, "lone text without an id at all")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "id", "block", 1, "kept") for i, t in rows], SCHEMA).repartition(3, F.col("text")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_equals_the_library(docs, none, rows):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    odd = ["don'T we'LL 's's", "a<|endoftext|>b <|startoftext|>", "İ Σς ½ \x1c \x85 x", "＇ﬁ e\u0301", "<|endoftext", "!!'s--"]
    more = docs.sparkSession.createDataFrame([(1000 + n, t) for n, t in enumerate(odd)], "doc_id long, text string")
    expected = Counter()
    for i, t in [*rows, *((1000 + n, t) for n, t in enumerate(odd))]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    both = docs.select("doc_id", "text").unionAll(more)
    got = bpe.encode(both, bpe.vocabulary_file(), max_bytes=4000).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == expected
    assert bpe.encode(none, bpe.vocabulary_file()).collect() == []


def byte_expectation(rows, width):
    data = [(i if i is not None else math.inf, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], math.inf), i)
    out = Counter()
    for (i, b), (name, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
        out[name, len(b), tuple(map(tuple, edges.tolist())), np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    return out


@pytest.mark.parametrize("width", [50, 40, 90])
def test_repeated_bytes(docs, none, rows, width):
    got = byte_dedup.without_repeated_bytes(docs, width=width, max_bytes=20_000).collect()
    found = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in got)
    assert found == byte_expectation(rows, width)
    assert byte_dedup.without_repeated_bytes(none).collect() == []


@pytest.mark.parametrize("width", [35, 12, 70])
def test_repeated_words(docs, none, rows, width):
    data = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + width]) for w in data for k in range(len(w) - width + 1))
    expected = Counter()
    for (i, _), words in zip(rows, data):
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - width + 1):
            if count[tuple(words[k : k + width])] > 1:
                gone[k : k + width] = True
        expected[i, len(words), " ".join(w for w, g in zip(words, gone) if not g)] += 1
    got = word_dedup.without_repeated_words(docs, width=width, max_bytes=20_000).collect()
    assert Counter((r.doc_id, r.n_words, r.kept) for r in got) == expected
    assert word_dedup.without_repeated_words(none).collect() == []


def test_window_search_over_pieces(monkeypatch):
    """Segments are the same windows wherever a piece ends."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 3000, np.uint8)
    corpus = windows.Corpus(data, np.array([700, 700, 730, 3000]), np.arange(4))
    covers = []
    for piece in (1 << 20, 256):
        monkeypatch.setattr(windows, "PIECE", piece)
        found = windows.segments(corpus, 50, 24, windows.byte_grams)
        starts = np.concatenate([np.arange(f, f + n) for f, n in zip(found.first, found.n)])
        anchors = np.repeat(found.anchor, found.n)
        covers.append((starts.tolist(), anchors.tolist()))
    assert covers[0] == covers[1]
    ends = [0, 700, 700, 730, 3000]
    assert covers[0][0] == [s for a, b in zip(ends, ends[1:]) for s in range(a, b - 49)]


def test_fm_index_windows():
    rng = random.Random(2)
    for _ in range(300):
        width, letters = rng.choice([3, 4, 5, 7]), rng.choice([2, 3, 8])
        base = [rng.randrange(letters) for _ in range(30)]
        parts = []
        for _ in range(rng.randrange(1, 7)):
            start = rng.randrange(20)
            part = base[start : start + rng.randrange(width, 2 * width + 6)]
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = rng.randrange(letters + 3)
            parts.append(part if len(part) >= width else part + [9] * width)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        index = fm_index.FMIndex(np.array(list(itertools.chain(*parts)), np.uint64) * np.uint64(77), ends, 64)
        starts = ends - sizes + np.arange(len(parts))
        count = Counter(tuple(p[k : k + width]) for p in parts for k in range(len(p) - width + 1))
        for part, mask in zip(parts, fm_index.repeated_windows(index, starts, starts + sizes, width)):
            expected = sum(1 << k for k in range(len(part) - width + 1) if count[tuple(part[k : k + width])] > 1)
            assert int(mask) == expected


def word_sets(rows, size=5):
    out = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def grouped(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[top(a)] = top(b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize(("percent", "leaf", "depth"), [(85, 256, 10), (80, 3, 2), (85, 4, 6)])
def test_near_duplicates(docs, none, rows, monkeypatch, percent, leaf, depth):
    monkeypatch.setattr(near, "LEAF", leaf)
    sets = word_sets(rows)
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and (
            100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
            or (rows[a][0] is not None and rows[a][0] == rows[b][0])
        )
    ]
    group = grouped(len(rows), pairs)
    names = {}
    for (i, _), g, s in zip(rows, group, sets):
        if s and i is not None:
            names[g] = min(names.get(g, i), i)
    expected = Counter()
    for (i, _), g, s in zip(rows, group, sets):
        name = names.get(g) if s else i
        expected[i, len(s), name, name is None or i == name] += 1
    got = near.near_duplicates(docs, percent=percent, depth=depth).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected
    assert near.near_duplicates(none).collect() == []


def test_one_row_of_each_group_stays(docs, none, rows):
    sets = word_sets(rows)
    got = near.without_near_duplicates(docs, percent=85)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    near_rows = near.near_duplicates(docs, percent=85).collect()
    groups = {r.component_id for r in near_rows if r.n_shingles and r.component_id is not None}
    named = [k for k in kept if k[0] is not None and WORD.search(k[1] or "")]
    assert {i for i, _ in named} == groups and len(named) == len(groups)
    assert sum(not s for s in sets) == sum(not WORD.search(t or "") for _, t in kept)
    assert (None, "lone text without an id at all") in kept
    assert near.without_near_duplicates(none).collect() == []


@pytest.mark.parametrize(("leaf", "depth"), [(48, 8), (2, 2)])
def test_line_classes(docs, none, rows, monkeypatch, leaf, depth):
    monkeypatch.setattr(lines, "LEAF", leaf)
    monkeypatch.setattr(lines, "DEPTH", depth)
    shingle = re.compile(lines.SHINGLE)
    key = lambda r: (r[0] is None, r[0] if r[0] is not None else 0)
    places = sorted({(i, t) for i, t in rows if t}, key=key)
    found = [(i, t, n, x) for i, t in places for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    distinct = list(dict.fromkeys(x for *_, x in found))
    sets = [frozenset(shingle.findall(x)) for x in distinct]
    pairs = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    group = dict(zip(distinct, grouped(len(distinct), pairs)))
    got = lines.line_classes(docs).collect()
    text_of = {}
    for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect():
        text_of[r.doc_id, r.h] = r.text
    classes = {}
    for r in got:
        line = text_of[r.doc_id, r.text_id].split("\n")[r.line_no]
        classes.setdefault(r.class_id, set()).add(group[line])
    assert all(len(g) == 1 for g in classes.values()) and len(classes) == len(set(group.values()))
    assert {(r.doc_id, r.text_id, r.line_no) for r in got} == {
        (r.doc_id, r.text_id, r.line_no) for r in got
    } and len(got) == sum(len([x for x in (t or "").split("\n") if x.strip(" ")]) for _, t in rows)
    first = {}
    for r in got:
        place = (r.doc_id is None, r.doc_id or 0, r.text_id, r.line_no)
        first[r.class_id] = min(first.get(r.class_id, place), place)
    assert all(r.kept == ((r.doc_id is None, r.doc_id or 0, r.text_id, r.line_no) == first[r.class_id]) for r in got)
    assert lines.line_classes(none).collect() == []
    kept = {(r.doc_id, r.text_id, r.line_no): r.kept for r in got}
    shorter = lines.without_repeated_lines(docs.withColumn("before", F.col("text")))
    for r in shorter.withColumn("h", F.xxhash64(F.coalesce("before", F.lit("")))).collect():
        if r.before is None:
            assert r.text is None
        else:
            parts = r.before.split("\n")
            assert r.text == "\n".join(x for n, x in enumerate(parts) if kept.get((r.doc_id, r.h, n), True))


def test_line_links_within_large_bands(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAF", 20)
    monkeypatch.setattr(lines, "BANDS", 1)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    head = [word() for _ in range(34)]
    found = []
    for _ in range(500):
        tail = [word() for _ in range(8)]
        # The pair shares 40 of 42 words, strangers share 34.
        found += [" ".join([*head, *tail]), " ".join([*head, *tail[:-2], word(), word()])]
    shingle = re.compile(lines.SHINGLE)
    sets = [frozenset(shingle.findall(x)) for x in found]
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert not any(alike(sets[0], s) for s in sets[2:])
    planted = {n for n in range(0, len(sets), 2) if alike(sets[n], sets[n + 1])}
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    class_of = {r.doc_id: r.class_id for r in lines.line_classes(docs).collect()}
    # Of the pairs that share the band none is lost.
    signed = lines._minhashes(docs.select(F.col("doc_id").alias("line_id"), F.col("text").alias("line")))
    band = {r[0]: r[1] for r in signed.select("line_id", lines._bands()[0]).collect()}
    size = Counter(band.values())
    meet = {n for n in planted if band[n] == band[n + 1] and size[band[n]] > 20}
    assert len(meet) > 50 and {n for n in meet if class_of[n] != class_of[n + 1]} == set()


def test_bands_meet_as_often_as_stated():
    rng = random.Random(14)
    orders = [n % (1 << 64) for n in lines._orders()]
    for size in (5, 10, 15, 30):
        met = 0
        for _ in range(1000):
            union = [rng.getrandbits(64) for _ in range(size)]
            sides = union[size // 10 :], union[: size // 10] + union[size // 5 :]  # similarity 0.8
            agree = [len({min(h ^ n for h in x) for x in sides}) == 1 for n in orders]
            met += any(all(agree[n] for n in lines._orders_of(b)) for b in range(lines.BANDS))
        assert met >= 985, (size, met)


def test_an_insertion_moves_only_its_neighbours(spark):
    rng = random.Random(13)
    line = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    url = "https://example.org/" + "".join(rng.choice("abcdefghij/") for _ in range(200))
    for text in (line, url, line.replace(line[50], "\t")):
        other = text[:3] + "x" + text[3:]
        got = lines.line_classes(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).collect()
        assert len({r.class_id for r in got}) == 1 and {r.doc_id: r.kept for r in got} == {1: True, 2: False}


def test_near_links_within_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 100)
    rng = random.Random(12)
    head = prose(rng, 120, 10**6).split(" ")
    found = []
    for _ in range(1500):
        tail = prose(rng, 70, 10**6).split(" ")
        # Of 186 shingles the pair shares about 167: similarity 0.81; strangers share 116 of 256.
        found += [" ".join([*head, *tail]), " ".join([*head, *tail[:-19], *prose(rng, 19, 10**6).split(" ")])]
    sets = word_sets(list(enumerate(found)))
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert all(alike(a, b) for a, b in zip(sets[::2], sets[1::2])) and not any(alike(sets[0], s) for s in sets[2:])
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs, trees=1).collect()}
    # Of the pairs that share the token of the only tree none is lost.
    named = docs.withColumnRenamed("doc_id", "id")
    token = {r.id: r.tokens[0] for r in near._sets(named, near.SHINGLE, 1).collect()}
    meet = {n for n in range(0, len(found), 2) if token[n] == token[n + 1]}
    assert len(meet) > 1000 and max(Counter(token.values()).values()) > 1000
    assert {n for n in meet if got[n] != got[n + 1]} == set()


def test_longest_agreeing_stretch():
    rng = random.Random(0)
    for _ in range(3000):
        equal = np.array([rng.random() < rng.choice([0.2, 0.8, 0.9]) for _ in range(rng.randrange(25))], bool)
        best = None
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                same = int(equal[a:b].sum())
                if equal[a] and equal[b - 1] and 100 * same >= 80 * (b - a) and (best is None or b - a > best[1]):
                    best = a, b - a, same
        assert decontamination.longest(equal, 80) == best


def test_masks_survive_any_two_substitutions():
    for places in itertools.combinations(range(decontamination.MIN_WORDS), 2):
        assert any(
            not any(p + o in places for o in mask)
            for mask in decontamination.MASKS for p in range(decontamination.MIN_WORDS - mask[-1])
        )


def test_masks_survive_all_substitutions_of_the_rule():
    for words in (*range(5, 13), *range(13, 20)):
        own = decontamination.masks(words, 80)
        for places in itertools.combinations(range(words), words // 5):
            assert any(not any(p + o in places for o in m) for m in own for p in range(words - m[-1])), (words, places)


def test_leaks_with_substitutions(spark):
    rng = random.Random(9)
    swap = lambda text, places: " ".join("zz" if n in places else w for n, w in enumerate(text.split(" ")))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    items = [prose(rng, n, 10**6) for n in (12, 12, 5, 15, 13)] + [han]
    cases = [
        swap(items[0], {6}), swap(items[1], {0, 11}), swap(items[2], {2}), swap(items[3], {3, 7, 11}),
        swap(items[4], {0, 12}), "x" + han[:20] + "一" + han[21:], swap(items[0], {2, 5, 8}), swap(items[2], {1, 3}), han[:12],
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(n, "some words before " + t + " and after") for n, t in enumerate(cases)], "doc_id long, text string")
    got = decontamination.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, n) for n in range(6)}
    assert all(100 * r.n_equal >= 80 * r.n_words for r in got)
    loose = decontamination.leaks(docs, bench, percent=60).collect()
    assert {(r.doc_id, r.item_id) for r in loose} == {(n, n) for n in range(6)} | {(6, 0), (7, 2)}


@pytest.mark.parametrize("part_words", [200_000, 30])
def test_leaks(spark, none, part_words):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (20, 45, 13, 7, 3, 30)]
    bench = spark.createDataFrame([*enumerate(items), (None, prose(rng, 15)), (9, None), (10, ""), (1, items[1])], "item_id long, text string")
    pad = lambda n: prose(rng, n, 3000)
    swap = lambda text, places: " ".join("zz" if n in places else w for n, w in enumerate(text.split(" ")))
    cases = [
        (pad(50) + " " + items[0].upper() + ", " + pad(9), {0}), (swap(items[1], {3, 11, 20, 30}), {1}),
        (pad(5) + " " + swap(items[2], {4, 9}), {2}), (pad(30) + " " + items[3], {3}), (items[4] + " " + pad(10), set()),
        (pad(400), set()), (" ".join(items[1].split(" ")[10:26]) + " " + pad(4), {1}), (None, set()), ("", set()),
        (" ".join(items[5].split(" ")[:8]) + " " + pad(40), set()), (items[0] + " " + items[1], {0, 1}),
    ]
    docs = spark.createDataFrame([(n, t, "x", 1) for n, (t, _) in enumerate(cases)], "doc_id long, text string, item string, id int")
    got = decontamination.leaks(docs, bench, part_words=part_words).collect()
    found = {n: {r.item_id for r in got if r.doc_id == n} for n in range(len(cases))}
    assert found == {n: e for n, (_, e) in enumerate(cases)}
    assert all(r.n_words >= min(13, len(items[r.item_id].split(" "))) and 100 * r.n_equal >= 80 * r.n_words for r in got)
    rest = decontamination.without_leaks(docs, bench, part_words=part_words)
    assert rest.columns == docs.columns and {r.doc_id for r in rest.collect()} == {n for n, (_, e) in enumerate(cases) if not e}
    assert decontamination.leaks(none, bench).collect() == []
    assert decontamination.leaks(docs, bench.limit(0)).collect() == []


def test_counts_beyond_32_bits_travel_whole():
    counts = np.array([0, 1, 2**32 - 1, 2**32, 2**32 + 7, 2**53 + 1], np.int64)
    assert language_model._large(language_model._small(counts), len(counts)).tolist() == counts.tolist()
    keys = language_model.squeezed(np.array([5, 9], np.uint64))
    block = lambda n: {
        "bucket": 0, "block": n, "n": 2, "keys": keys, "counted": language_model._small(np.array([2**32 - 1, 1])),
        "deleted": language_model._small(np.array([1, 0])),
    }
    got = language_model._added(pa.Table.from_pylist([block(0), block(1)]))
    assert language_model._large(got.column("both")[0].as_py(), 2).tolist() == [2**33, 2]


def test_language_model(docs, none, rows):
    words = [[*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), " end"] for _, t in rows]
    out_of = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(w for t, o in zip(words, out_of) if not o for w in t)
    total, vocabulary = sum(count.values()), len(count)
    expected = Counter()
    for (i, _), t, o in zip(rows, words, out_of):
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (vocabulary + 1))) for w in t)
        expected[i, o, len(t), sum(count[w] > 0 for w in t), total, round(base, 6)] += 1
    train, deleted = ~quality.held_out("doc_id", 5, 1), quality.held_out("doc_id", 5, 0)
    got = language_model.scores(docs, train, deleted, max_bytes=20_000).collect()
    found = Counter((r.doc_id, r.part == language_model.OTHER, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert found == expected and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert language_model.scores(none, train, deleted).collect() == []
    untaught = language_model.scores(docs, F.lit(False), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in untaught)


def test_mixture_weights_rise_with_the_likelihood():
    """The learned mixture is at least as likely as any other of a grid."""
    rng = np.random.default_rng(1)
    code = np.unique(3 * 65536 + rng.integers(4, 60, 40) * 256 + rng.integers(20, 80, 40))
    n = rng.integers(1, 50, len(code))
    mix = language_model.weights(code, n, 1000)[3]
    p = np.stack([2.0 ** (-(code // 256 % 256) / 4), 2.0 ** (-(code % 256) / 4), np.full(len(code), 1 / 1001)], 1)
    best = (n * np.log(p @ mix)).sum()
    for a in np.linspace(0, 1, 11):
        for b in np.linspace(0, 1 - a, 6):
            assert best >= (n * np.log(p @ [a, b, 1 - a - b] + 1e-300)).sum() - 1e-3
    assert abs(mix.sum() - 1) < 1e-9


def test_the_cut_covers_all_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    ranking = quality.fit(docs, labels, sample_rows=100)
    known = docs.join(labels.where("quality in (0, 1)"), "doc_id").select("quality", quality._total(F.col("text"), ranking))
    found = known.collect()
    share = 1 - sum(r[0] for r in found) / len(found)
    assert ranking.rows < len(found) and abs(np.quantile([r[1] for r in found], share)) < 1e-9
    values = [random.Random(1).gauss(0, 1) for _ in range(300)] + [0.5] * 200
    rows = spark.createDataFrame([(v,) for v in values], "score double")
    for q in (0, 0.31, 0.75, 1):
        assert abs(quality.quantile(rows, q, 20, 10) - np.quantile(values, q)) < 1e-12


def test_quality_learns_held_out_labels(spark, small_dir, none):
    got = quality.op10_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in held) >= 0.95 * len(held) > 0
    empty = quality.fit(none, labels)
    assert empty.rows == 0
    for text in (None, "", "short clean text"):
        row = spark.createDataFrame([(1, text)], "doc_id long, text string").select(quality.score(F.col("text"), empty)).first()
        assert row[0] == 0.5
    odd = spark.createDataFrame([(1, 1, "a"), (2, None, "b"), (None, 0, "c")], "doc_id long, quality int, text string")
    assert quality.fit(odd.select("doc_id", "text"), odd.select("doc_id", "quality", "text")).rows == 1
