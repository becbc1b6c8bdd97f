"""Recursive branching of near-duplicate nodes: its rates, and recall within large groups."""

import random

import numpy as np
import pytest

from storeflow.llm import near, work


def made_up(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_a_pair_survives_any_depth(percent):
    rng = np.random.default_rng(percent)
    count, trials = near.branches(percent), 20_000
    alive = rng.binomial(1, percent / 100, trials)
    for _ in range(12):
        alive = rng.binomial(np.minimum(alive, 500) * count, percent / 100)
    assert abs((alive > 0).mean() - near.survival(percent)) < 0.015
    trees = near.trees_for(percent, 0.999)
    assert (1 - near.survival(percent)) ** trees <= 0.001 < (1 - near.survival(percent)) ** (trees - 1)
    assert near.trees_for(100, 0.999) == 1


def test_children_share_a_token_as_often_as_they_are_similar(spark):
    """The tokens of different nodes and of different branches are independent."""
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(1)
    union = rng.integers(0, 2**63, 1000)
    sides = [np.sort(union[:900]), np.sort(union[100:])]  # similarity 0.8
    nodes = rng.integers(-(2**63), 2**63, 4000)
    rows = pa.record_batch(
        [pa.array([b"a", b"b"]), pa.array([nodes, nodes], pa.list_(pa.int64())), pa.array(sides, pa.list_(pa.int64()))],
        names=["id", "nodes", "set"],
    )
    out = next(near._branched(2)([rows]))
    child = out.column("node").to_numpy().reshape(2, len(nodes), 2)
    met = child[0] == child[1]
    assert abs(met.mean() - 0.8) < 0.02 and abs(met.all(1).mean() - 0.64) < 0.03
    assert len(np.unique(child[0])) == child[0].size


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_within_a_large_group(spark, monkeypatch, percent):
    """3,000 texts that share a passage, in pairs just above the threshold: nodes are large and branch."""
    monkeypatch.setattr(near, "LEAF", 150)
    dealt, branched = [], []
    deal, branch = work.dealt, near._branched
    monkeypatch.setattr(work, "dealt", lambda placed, nodes, leaf: dealt.append(nodes.count()) or deal(placed, nodes, leaf))
    monkeypatch.setattr(near, "_branched", lambda count: branched.append(count) or branch(count))
    rng = random.Random(percent)
    head = made_up(rng, 40)
    texts = []
    for _ in range(1500):
        tail = made_up(rng, 160)
        new = {80: 21, 85: 15}[percent]  # of 196 shingles
        texts += [head + tail, head + tail[:-new] + made_up(rng, new)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    for a, b in zip(sets[::2], sets[1::2]):
        assert percent <= 100 * len(a & b) / len(a | b) < percent + 2
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs, percent=percent).collect()}
    assert branched and all(c == 2 for c in branched) and dealt[0] <= 10
    found = sum(got[n] == got[n + 1] == n for n in range(0, len(texts), 2))
    assert found >= 0.99 * len(texts) / 2
    assert len(set(got.values())) == len(texts) - found
