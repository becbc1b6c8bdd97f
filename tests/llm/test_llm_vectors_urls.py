"""Vector search and URL filter against brute force."""

import math
import random

import pytest

from storeflow.llm import url_filter, vector_search

WHOLE = "vec_id long, embedding array<float>, id string, score int"


def brute(rows, asked, k):
    clean = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)), key=str):
        whole = [math.floor(1024 * x) for x in v]
        clean[i, len(whole)] = min(clean.get((i, len(whole)), whole), whole)
    out = set()
    for (q, n), v in clean.items():
        if q in asked:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for (i, m), w in clean.items() if m == n and i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_top_products(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vector_search, "LEAF_ROWS", 8)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 15)
    rng = random.Random(4)
    point = lambda n=6: [rng.choice([rng.uniform(-1, 1), 0.25, -0.5]) for _ in range(n)]
    rows = [(n, point()) for n in range(300)]
    rows += [(400 + n, rows[0][1]) for n in range(25)] + [(500 + n, point(3)) for n in range(4)]
    rows += [(600, None), (601, []), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [math.nan] * 6), (604, [math.inf] * 6), (None, point())]
    rows += [(0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], WHOLE)
    got = vector_search.top_products(frame, frame.where("vec_id % 10 = 0"), shard_rows=shard_rows).collect()
    exact = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in
             ((r.vec_id, r.embedding) for r in frame.collect())]
    expected = brute(exact, {i for i, _ in rows if i is not None and i % 10 == 0}, 10)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    nothing = frame.limit(0)
    assert vector_search.top_products(nothing, nothing).collect() == []
    assert vector_search.top_products(frame, nothing).collect() == []


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    name, rest = rest[:cut], rest[cut:]
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in name), rest[:stop]


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme.org/", "http://a.org", "http://A.ORG/", "http://org/x", "https://xorg/", "http://Example.org/es/1?x=/de/#y",
        "http://b.example.org/en/17", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/://y",
        "http://x.com?/de/", "http://x.com#/de/", "ftp://u@h.com:80/de/", "http://ÄÖ.com/de/ü", "a://b://c.org/", "http://x.net/" + "y/" * 3000,
    ]
    frame = spark.createDataFrame([(n, u, "h", "r") for n, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.url_verdicts(frame).collect()}
    assert len(got) == len(urls) + 1
    for n, url in enumerate(urls):
        name, place = plain(url)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (name == h or name.endswith("." + h)) and place.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (got[n].host, got[n].path, got[n].rule) == (name, place, rule)
        assert got[n].verdict == verdict if verdict else got[n].verdict in ("allow", "block")
    assert url_filter.url_verdicts(frame.limit(0)).collect() == []


def test_trees_learn_lexical_labels(spark):
    rng = random.Random(1)
    rows = []
    for n in range(1200):
        bad = n % 2
        host = f"{'win-' if bad else ''}{rng.randrange(40)}.{'bets' if bad else 'site'}{rng.randrange(3)}.net"
        rows.append((f"http://{host}/{'x' * rng.randrange(9)}{rng.randrange(10 ** (8 if bad else 2))}", bad))
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    learned = url_filter.fit(labelled.limit(800))
    judged = url_filter.judged(labelled, learned).collect()
    assert sum((r.p_block >= 0.5) == bool(r.blocked) for r in judged) >= 0.97 * len(judged)
    assert url_filter.judged(labelled, url_filter.fit(labelled.limit(0))).where("p_block > 0").isEmpty()
    assert url_filter.judged(labelled, url_filter.fit(labelled.where("blocked = 1"))).where("p_block < 1").isEmpty()
