"""Benchmark items of any length by brute force, and vectors with large components."""

import random
from collections import Counter

import pytest

from storeflow.llm import decontamination as D
from storeflow.llm import vector_search


def longest(equal, percent):
    """(start, length, equal places) by trying every stretch."""
    best = None
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            same = sum(equal[a:b])
            if equal[a] and equal[b - 1] and 100 * same >= percent * (b - a) and (best is None or b - a > best[1]):
                best = a, b - a, same
    return best


def brute(docs, items, least, percent):
    out = Counter()
    for d, text in docs:
        for i, item in items:
            x, y = (text or "").split(), (item or "").split()
            for shift in range(1 - len(y), len(x)) if y else ():
                places = range(max(0, shift), min(len(x), shift + len(y)))
                equal = [x[k] == y[k - shift] for k in places]
                found = longest(equal, percent)
                if not (found and found[1] >= least):
                    found = (0, len(y), sum(equal)) if len(equal) == len(y) and 100 * sum(equal) >= percent * len(y) else None
                if found:
                    first = places[0] + found[0]
                    out[d, i, first, first - shift, found[1], found[2]] += 1
    return out


@pytest.mark.parametrize(("least", "percent"), [(13, 80), (3, 90)])
def test_leaks_of_items_of_any_length(spark, least, percent):
    rng = random.Random(least)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(words) for _ in range(size))) for n, size in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 13, 14, 18, 30])]
    items += [(50, None), (51, ""), (0, items[0][1])]
    docs = []
    for n in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(25))]
        copy = rng.choice(items)[1]
        if copy:
            text[len(text) // 2 : len(text) // 2] = [w if rng.random() < 0.9 else "other" for w in copy.split()]
        docs.append((n, " ".join(text)))
    docs += [(100, None), (101, ""), (102, items[3][1])]
    docs += [(200 + n, "before " + items[n][1]) for n in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, D.leaks(frame, bench, min_words=least, percent=percent, least_item=1).collect()))
    expected = brute(docs, items, least, percent)
    assert got == expected and {i for _, i, *_ in got} >= {0, 1, 2, 3, 4, 5}
    kept = {r.doc_id for r in D.without_leaks(frame, bench, min_words=least, percent=percent).collect()}
    long = [(i, t) for i, t in items if len((t or "").split()) >= D.LEAST_WORDS]
    assert kept == {d for d, _ in docs} - {d for d, *_ in brute(docs, long, least, percent)} and 102 in kept


def test_products_of_large_components(spark):
    rng = random.Random(3)
    rows = [(n, [rng.uniform(-1, 1) * 10 ** rng.randrange(7), rng.uniform(-2.9e6, 2.9e6) if n % 3 else 1.5]) for n in range(200)]
    rows += [(200, [2000.0, 1.0]), (300, [0.25, 2.9e6]), (301, [0.5, 2.9e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_products(frame, frame.where("vec_id % 100 = 0"), k=3, shard_rows=50).collect()
    whole = {i: [int(1024 * x // 1) for x in v] for i, v in rows}
    expected = set()
    for q in (0, 100, 200, 300):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)
        expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:3])}
    assert {tuple(r) for r in got} == expected and max(s for *_, s in expected) > 1 << 62
