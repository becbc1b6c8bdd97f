"""The registered queries over a small folder of tables: splits, digests and column types by brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storeflow.llm import blocks, bpe, byte_dedup, language_model, near, quality, url_filter, vector_search, word_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('abcdeFGH')}{min(rng.randrange(300), rng.randrange(300))}" for _ in range(n))
    base = [prose(n) for n in (120, 90, 200, 60, 45)]
    out = [*base, base[0], base[2], None, "", " \n\t ", "one", "Ünï 日本語 😀 É", "a b c d", "A B C D"]
    for n in range(40):
        words = base[n % 5].split(" ")
        for _ in range(n % 4):
            words[rng.randrange(len(words))] = f"x{n}"
        out.append(" ".join(words))
    return out + [f"{prose(30)} {base[1]} {prose(25)}", base[3] * 2] + [prose(rng.randrange(80)) for _ in range(60)]


@pytest.fixture(scope="module")
def rows():
    """Ids with gaps, not in the order of the rows."""
    found = texts()
    ids = random.Random(2).sample(range(1000), len(found))
    return list(zip(ids, found))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def types(frame):
    return dict(frame.dtypes)


def test_op1(spark, folder, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    expected = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe.op1_bpe_words(spark, folder)
    assert types(got) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("seed", [1, 2])
def test_op2(spark, tmp_path, seed):
    rng = random.Random(seed)
    vectors = [(n, [rng.choice([-0.5, 0.25, 0.0011, rng.random()]) for _ in range(4)]) for n in range(0, 700, 1 + seed)]
    odd = [(9000, None), (9100, [1.0, None, 0.0, 1.0]), (9200, [1.0, math.inf, 0.0, 1.0]), (9300, [math.nan, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors + odd], "vec_id long, embedding array<float>, label int")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors}
    expected = set()
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:10]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    got = vector_search.op2_top_products(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score")
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert set(map(tuple, got.collect())) == expected


def test_op3(spark, folder, rows, monkeypatch):
    """Scores recomputed from plain counts and the learned weights; the weights by EM over single tokens."""
    learned = []
    weights = language_model.weights
    monkeypatch.setattr(language_model, "weights", lambda *a: learned.append(weights(*a)) or learned[-1])
    got = language_model.op3_interpolated_lm(spark, folder)
    assert types(got) == {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
        "base_score": "double", "score": "double",
    }
    (mix,) = learned
    words = {i: [*WORD.findall(lower(t)), " end"] for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in words}
    pairs = {i: list(zip([" start", *t], t)) for i, t in words.items()}

    def counts(ids):
        one, two = Counter(), Counter()
        for i in ids:
            one.update(words[i])
            two.update(pairs[i])
        one[" start"] = one[" end"]
        return one, two, sum(n for w, n in one.items() if w != " start"), sum(n > 0 for w, n in one.items() if w != " start")

    def kind(context):
        return min(math.ceil(math.log2(context + 1)), language_model.CLASSES - 1)

    one, two, total, size = counts(i for i in words if fold[i] != 1)
    for r in got.collect():
        base = score = known = 0
        for before, word in pairs[r.doc_id]:
            a, b, c = mix[kind(one[before])]
            base += math.log10((one[word] + 0.5) / (total + 0.5 * (size + 1)))
            found = (a * two[before, word] / one[before] if one[before] else 0) + b * one[word] / total + c / (size + 1)
            score += math.log10(found / ((a if one[before] else 0) + b + c))
            known += one[word] > 0
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 1, len(words[r.doc_id]), known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6

    # The weights were learned on the documents of one fold, against the counts of the others.
    one, two, total, size = counts(i for i in words if fold[i] not in (0, 1))
    events = defaultdict(list)
    for i in (i for i in words if fold[i] == 0):
        for before, word in pairs[i]:
            share = two[before, word] / one[before] if one[before] else 0.0
            events[kind(one[before])].append((share, one[word] / total, 1 / (size + 1)))
    for number, p in events.items():
        p, own = np.array(p), np.full(3, 1 / 3)
        for _ in range(language_model.ROUNDS):
            each = p * own
            own = (each / each.sum(1, keepdims=True)).mean(0)
        likelihood = lambda w: np.log(p @ w).mean()
        assert likelihood(mix[number]) > likelihood(own) - 0.02, number


def test_op5(spark, folder, rows):
    sets = {}
    for i, t in rows:
        words = WORD.findall(lower(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = near.op5_near_dedup(spark, folder).select("doc_id", "n_shingles", "component_id", "kept")
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    expected = sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())
    assert sorted(map(tuple, got.collect())) == expected and sum(not kept for *_, kept in expected) > 20


def test_op6(spark, tmp_path):
    rng = random.Random(4)
    hosts = ["a.org", "ORG", "xorg", "example.org", "www.Example.ORG", "b.com", "com", "c.net", "a.com:80"]
    paths = ["", "/", "/fr/1", "/fr", "/de/x?/fr/", "/es/9", "/en/12#a", "/en/2", "?q=/de/", "#/de/"]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}{n}" for n in range(300)] + [None, "", "a.org/de/", "x://"]
    frame = spark.createDataFrame([(n, u, "<p>") for n, u in enumerate(urls)], "page_id long, url string, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = {r.page_id: r for r in url_filter.op6_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls)
    for n, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = lower(host)
        fits = [
            (len(h + p), h + p, verdict) for verdict, h, p in rules
            if (host == h or host.endswith("." + h)) and rest[len(host) :].startswith(p) and path.startswith(p)
        ]
        r = got[n]
        assert (r.host, r.path) == (host, path), url
        assert r.rule == (max(fits)[1] if fits else None), url
        assert r.verdict == (max(fits)[2] if fits else "block" if r.p_block >= 0.5 else "allow"), url


def test_op7(spark, folder, rows):
    data = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i, b in data.items():
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    expected = []
    for i, b in data.items():
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    got = byte_dedup.op7_byte_dedup(spark, folder)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got.dtypes == [*((c, "bigint") for c in names[:4]), (names[4], "string")]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and any(n for _, _, n, *_ in expected)


def test_op8(spark, folder, rows):
    data = {i: WORD.findall(t or "") for i, t in rows}
    count = Counter(tuple(w[k : k + 35]) for w in data.values() for k in range(len(w) - 34))
    expected = []
    for i, words in data.items():
        gone = [False] * len(words)
        for k in range(len(words) - 34):
            if count[tuple(words[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        expected.append((i, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g))))
    got = word_dedup.op8_word_dedup(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and any(n for _, _, n, _ in expected)


def test_op10_splits_and_types(spark, small_dir):
    got = quality.op10_quality(spark, small_dir)
    assert types(got) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    found = got.collect()
    assert len(found) == spark.read.parquet(f"{small_dir}/documents.parquet").count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_pair_weights_minimise_the_loss():
    """Against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    good = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) > 0
    found = quality.pair_weights(x, good, pairs=5000, seed=9)
    draw = np.random.default_rng(9)
    diff = x[draw.choice(np.flatnonzero(good), 5000)] - x[draw.choice(np.flatnonzero(~good), 5000)]
    own = np.zeros(4)
    for _ in range(20_000):
        slope = diff.T @ (1 / (1 + np.exp(-diff @ own)) - 1) / 5000 + quality.RIDGE * own
        own -= 0.2 * slope
    assert np.abs(slope).max() < 1e-6 and np.abs(found - own).max() < 1e-3


def test_buckets_follow_the_input(spark, folder, monkeypatch):
    """More and smaller buckets for more text, with the same results."""
    run = {f.__name__: f for f in (bpe.op1_bpe_words, language_model.op3_interpolated_lm, byte_dedup.op7_byte_dedup, word_dedup.op8_word_dedup)}
    plain = lambda frame: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.collect())
    before = {name: plain(f(spark, folder)) for name, f in run.items()}
    docs = blocks.narrow(spark.read.parquet(f"{folder}/documents.parquet"))
    assert blocks.value_buckets(docs) == blocks.buckets(spark) == blocks.value_buckets(docs.limit(0))
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 1000)
    one, two = blocks.value_buckets(docs), blocks.value_buckets(docs.unionAll(docs))
    assert one > 4 * blocks.buckets(spark) and abs(two - 2 * one) <= 1
    for name, f in run.items():
        assert plain(f(spark, folder)) == before[name], name
