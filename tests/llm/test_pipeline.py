"""The pipeline, stage by stage, against brute force."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storeflow.llm import bpe, lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, small_dir, tmp_path_factory):
    """The documents before and after every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = [(10_000, None), (10_001, ""), (10_002, "  \n \n"), (None, "a text without an id")]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in odd], docs.schema)
    out = [docs.unionAll(extra)]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], small_dir).write.parquet(str(folder / str(n)))
        out.append(spark.read.parquet(str(folder / str(n))))
    return [frame.collect() for frame in out], [frame.columns for frame in out]


def test_stages_keep_the_columns(steps):
    _, columns = steps
    assert columns[1] == columns[2] == columns[3] == columns[4] == columns[0]
    assert columns[5] == ["doc_id", "n_tokens", "ids", "decoded"]


def test_quality_keeps_good_documents(spark, small_dir, steps):
    (before, after, *_), _ = steps
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_lines_are_unique_and_nothing_else_goes(steps):
    (_, before, after, *_), _ = steps
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after if r.text is not None)
    for r in before:
        mine = iter((r.text or "").split("\n"))
        assert all(any(x == y for y in mine) for x in (texts[r.doc_id] or "").split("\n") if x)
    shingle = re.compile(lines.SHINGLE)
    left = [frozenset(shingle.findall(x)) for r in after for x in (r.text or "").split("\n") if x.strip(" ")]
    assert len(left) == len(set(left))
    gone = sum(len((r.text or "").split("\n")) for r in before) - sum(len((r.text or "").split("\n")) for r in after)
    assert gone > 0


def test_no_near_duplicates_are_left(steps):
    (_, _, before, after, *_), _ = steps

    def shingles(text):
        w = WORD.findall(text or "")
        return frozenset(tuple(x.lower() for x in w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    kept = [(r.doc_id, shingles(r.text)) for r in after]
    for (_, a), (_, b) in itertools.combinations(kept, 2):
        assert not a or not b or 100 * len(a & b) < 80 * len(a | b)
    ids = {r.doc_id for r in after}
    for r in before:
        if r.doc_id not in ids:
            mine = shingles(r.text)
            assert any(100 * len(mine & b) >= 80 * len(mine | b) for b in (shingles(x.text) for x in before if x is not r) if b)


def test_benchmark_passages_go(spark, small_dir, steps):
    (_, _, _, before, after, _), _ = steps
    word = re.compile(r"[^\W_]+")
    items = [" ".join(word.findall(r.text.lower())) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    plain = {r.doc_id: " ".join(word.findall((r.text or "").lower())) for r in before}
    ids = {r.doc_id for r in after}
    assert {i for i, t in plain.items() if any(f" {x} " in f" {t} " for x in items)}.isdisjoint(ids)
    runs = {tuple(w[k : k + 6]) for w in (x.split(" ") for x in items) for k in range(len(w) - 5)}
    for i, t in plain.items():
        w = t.split(" ")
        assert i in ids or any(tuple(w[k : k + 6]) in runs for k in range(len(w) - 5))


def test_tokens_of_what_is_left(steps):
    (*_, before, after), _ = steps
    known = bpe.Vocabulary(bpe.vocabulary_file())
    expected = sorted(((r.doc_id is None, r.doc_id or 0), [i for w in bpe.WORD.findall(r.text or "") for i in known.word(w)]) for r in before)
    assert sorted(((r.doc_id is None, r.doc_id or 0), list(r.ids)) for r in after) == expected
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_an_empty_table_runs_through(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir)
    assert docs.filter(F.lit(True)).collect() == []
