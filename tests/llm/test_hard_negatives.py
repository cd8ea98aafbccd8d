"""Hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from stepforge.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, positive string"


def brute(rows):
    """rows: (vec_id, label, vector)"""
    fine = [(i, (b + 1) % 10 if i % 7 == 0 else b, [int(np.floor(256 * x)) for x in v]) for i, b, v, *_ in rows if None not in (i, b, v) and v and None not in v and np.isfinite(v).all()]
    out = []
    for a, (i, b, v) in enumerate(fine):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, k) for k, (j, _, w) in enumerate(fine) if k != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if fine[x[2]][1] == b][:5]:
            negatives = [x for x in scored if fine[x[2]][1] != b and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(negatives)]
    return out


def made(seed, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 6))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % clusters] + rng.normal(size=6) * 0.2).round(2).tolist(), "x", "y") for i in range(900)]
    rows += [(1000 + i, i % 3, rows[0][2], "x", "y") for i in range(300)]  # one vector many times
    rows += [(1400, None, rows[1][2], "x", "y"), (1500, 1, None, "x", "y"), (1600, 1, [], "x", "y"), (1700, 1, [float("nan")] * 6, "x", "y"), (1800, 1, [None] * 6, "x", "y"), (None, 1, rows[1][2], "x", "y"), (1900, 1, [0.0] * 6, "x", "y"), (2000, 9, [1.0, 2.0], "x", "y"), (2001, 9, [1.0, 2.0], "x", "y"), (2002, 3, [1.0, 0.5], "x", "y")]
    return [*rows, rows[0], rows[100]]


@pytest.mark.parametrize(("seed", "clusters", "block"), [(0, 1, 32_768), (1, 12, 200), (2, 40, 500)])
def test_random_rows(spark, monkeypatch, seed, clusters, block):
    monkeypatch.setattr("stepforge.llm.vectors.BLOCK_ROWS", block)
    rows = made(seed, clusters)
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_embeddings(embeddings):
    got = hn.hard_negatives(embeddings).collect()
    assert sorted(map(tuple, got)) == sorted(brute([(r.vec_id, r.label, r.embedding) for r in embeddings.collect()]))
    assert hn.hard_negatives(embeddings.limit(0)).collect() == []


def space(seed, clusters, n=4000, d=4):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(clusters, d)) * 300)[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 10
    return v.astype(np.int64), rng.integers(0, 5, n)


@pytest.mark.parametrize("clusters", [1, 30])
def test_intervals_hold_every_product(clusters):
    v, labels = space(3, clusters, 500)
    a, b = hn.Tree(v[:100], labels[:100], 8), hn.Tree(v, labels, 16)
    low, high = hn.intervals(a, b)
    for i in range(len(a.start)):
        for j in range(len(b.start)):
            s = v[:100][a.rows(i)] @ v[b.rows(j)].T
            assert low[i, j] <= s.min() and s.max() <= high[i, j]
    assert sorted(np.concatenate([b.rows(i) for i in np.flatnonzero(b.leaf)])) == list(range(500))
    assert (b.size[b.leaf] <= 16).all()


@pytest.mark.parametrize("same", [True, False])
def test_node_pairs_are_pruned(same, monkeypatch):
    """On clustered vectors, and leaves as small as clusters, most products are never made, and the k best are found all the same."""
    for name, size in (("ANCHOR_LEAF", 4), ("CANDIDATE_LEAF", 16), ("FIRST", 64)):
        monkeypatch.setattr(hn, name, size)
    v, labels = space(4, 30)
    anchors = np.arange(0, len(v), 8)
    n = len(anchors)
    low, high = np.full(n, -(10**5)), np.full(n, 10**18)
    ask, at, score, made = hn.searched(v[anchors], labels[anchors], anchors, np.arange(n), low, high, v, labels, np.arange(len(v)), same, 5)
    assert made < 0.5 * n * len(v)
    every = v[anchors] @ v.T
    for i in range(n):
        fits = [j for j in np.lexsort((np.arange(len(v)), -every[i])) if j != anchors[i] and (labels[j] == labels[anchors[i]]) == same and every[i, j] >= low[i]][:5]
        assert at[ask == i].tolist() == fits and score[ask == i].tolist() == every[i, fits].tolist()


def test_limits_of_large_scores(spark):
    """0.3 and 0.9 of a score are exact, though 90 times the score is beyond a long."""
    x = 2.0**22 + 3
    rows = [(0, 1, [x, 0.0]), (1, 1, [x, 1.0]), *[(k, 2, [x * f, 0.0]) for k, f in ((2, 0.95), (3, 0.9), (4, 0.5), (5, 0.31), (6, 0.29))], (8, 3, [-x, 0.0])]
    got = hn.hard_negatives(spark.createDataFrame([(i, b, v, "", "") for i, b, v in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)) and {r.negative_id for r in got} == {3, 4, 5}
