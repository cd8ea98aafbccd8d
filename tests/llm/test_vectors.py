"""Searches among vectors against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stepforge.llm import neighbours, topk

SCHEMA = "vec_id long, embedding array<double>, rank string, score string"


def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist(), "a", "b") for i in range(120)]
    rows += [(200 + i, rows[0][1], "a", "b") for i in range(40)]  # one vector many times
    rows += [(300, None, "a", "b"), (350, [], "a", "b"), (400, [0.0] * 8, "a", "b"), (450, [float("nan")] * 8, "a", "b"), (500, [None] * 8, "a", "b"), (550, [float("inf")] * 8, "a", "b"), (None, rows[1][1], "a", "b"), rows[0]]
    return spark.createDataFrame(rows, SCHEMA), rows


def usable(rows, zero):
    return [(i, np.array(v)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and (zero or any(v))]


def brute(rows, every, k, scale=None):
    out = []
    for a, (i, v) in enumerate(rows):
        if i % every:
            continue
        q = lambda x: np.floor(scale * x) if scale else x
        best = sorted(((-float(q(v) @ q(w)), j) for b, (j, w) in enumerate(rows) if b != a))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def test_top_k(spark, embeddings):
    frame, rows = odd_vectors(spark)
    got = topk.exact_top_k(frame, every=50, k=5).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(usable(rows, True), 50, 5, 256))
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    got = topk.exact_top_k(embeddings).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(usable(rows, True), 50, 5, 256))


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.exact_top_k(few).collect()) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    assert topk.exact_top_k(few.limit(0)).collect() == []
    large = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in sorted(topk.exact_top_k(large, k=2).collect())] == [1, 2]


def test_top_k_is_found_by_the_histograms(spark, embeddings, monkeypatch):
    """The kth scores that the histograms locate decide what is returned: with other ones, other rows are."""
    rows = usable([(r.vec_id, r.embedding) for r in embeddings.collect()], True)
    want = {}
    for i, n, _, s in brute(rows, 50, 5, 256):
        want.setdefault(i, []).append(s)
    seen, real = {}, topk.kth_scores

    def spied(asks, most, k, against):
        out = real(asks, most, k, against)
        seen.update({r.vec_id: (r.lo, r.need) for r in out.join(asks, "place").collect()})
        return out.withColumn("lo", F.col("lo") - 6000)

    monkeypatch.setattr(topk, "kth_scores", spied)
    assert len(topk.exact_top_k(embeddings).collect()) > 5 * len(want)
    assert seen == {i: (s[-1], s.count(s[-1])) for i, s in want.items()}


def test_top_k_of_large_components(spark):
    """Beyond 2 ** 52 scores are whole numbers still; vectors whose scores a long need not hold take no part."""
    rows = [(0, [2.0**20 + 1, 3.0]), (1, [2.0**20, 5.0]), (2, [2.0**20, 4.0]), (50, [1e17, 0.0]), (3, [1e300, 1e300]), (100, [0.0, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    whole = {i: [int(256 * x) for x in v] for i, v in rows if max(v) < 1e10}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    assert sorted(map(tuple, got)) == [(0, 1, 1, score(0, 1)), (0, 2, 2, score(0, 2)), (100, 1, 0, 0), (100, 2, 1, 0)]


def test_nearest(spark, embeddings):
    rows = usable([(r.vec_id, r.embedding) for r in embeddings.collect()], False)
    want = {}
    for i, _, j, _ in brute(rows, 20, 20):
        want.setdefault(i, set()).add(j)
    got = {}
    vectors = dict(rows)
    for r in neighbours.nearest(embeddings).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-9
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert all([-s for s, _ in (g[k] for k in sorted(g))] == sorted(-s for s, _ in g.values()) for g in got.values())
    assert np.mean([len({j for _, j in got[i].values()} & want[i]) / 20 for i in want]) >= 0.9


def test_nearest_odd(spark):
    frame, rows = odd_vectors(spark)
    got = neighbours.nearest(frame, every=50, k=5).collect()
    fine = usable(rows, False)
    assert {r.query_id for r in got} == {i for i, _ in fine if i % 50 == 0}
    copies = sorted(r.vec_id for r in got if r.query_id == 200)
    assert copies == sorted([0, 0, 201, 202, 203])  # ties to the smallest ids, the repeated row twice
    assert neighbours.nearest(frame.limit(0)).collect() == []


def test_nearest_on_ranges(spark):
    """Recall of the operator where it has ranges to look through: 2,000 vectors."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids, m = np.array(list(rows)), np.stack(list(rows.values()))
    got = {}
    for r in neighbours.nearest(vectors).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q, found in got.items():
        score = np.where(ids == q, -np.inf, m @ rows[q])
        recall.append(len(found & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert len(got) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9


def test_nearest_of_huge_and_tiny_components(spark):
    """Finite components of any size: scores that overflow are infinite, those that are no numbers count as the least."""
    rng = np.random.default_rng(2)
    for scale in (1e150, 1e-150):
        rows = [(i, (rng.normal(size=4) * scale).tolist()) for i in range(30)]
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=5).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(x[:3] for x in brute(usable(rows, False), 10, 5))
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1e200, 1.0]), (3, [-1e200, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 2, np.inf), (0, 2, 1, -np.inf), (0, 3, 3, -np.inf)]


def test_nearest_with_a_hot_vector(spark):
    """A third of the rows is one vector: queries among them find its smallest ids, and the others lose no recall."""
    rng = np.random.default_rng(7)
    one, *others = rng.normal(size=(4001, 16))
    rows = [(i, one if i % 3 == 0 else others[2 * (i // 3) + i % 3 - 1]) for i in range(6000)]
    rows = [(i, (v / np.sqrt(v @ v)).tolist()) for i, v in rows]
    vectors = np.array([v for _, v in rows])
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    recall = []
    for q in range(0, 6000, 100):
        if q % 3 == 0:
            assert [got[q][n] for n in range(1, 21)] == [i for i in range(0, 63, 3) if i != q][:20]
        scores = np.where(np.arange(6000) == q, -np.inf, (vectors @ vectors[q]).round(12))
        want = np.lexsort((np.arange(6000), -scores))[:20]
        recall.append(len(set(want.tolist()) & set(got[q].values())) / 20)
    assert len(got) == 60 and np.mean(recall) >= 0.9


def test_nearest_few(spark):
    """All candidates are found where there are few of a length, also beside many of another length."""
    rng = np.random.default_rng(9)
    many = [(1000 + i, rng.normal(size=6).tolist()) for i in range(2000)]
    for n, beside in ((3, []), (10, []), (21, []), (10, many)):
        rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
        frame = spark.createDataFrame(rows + beside, "vec_id long, embedding array<double>")
        got = neighbours.nearest(frame.withColumn("vec_id", F.expr("if(vec_id < 1000, vec_id * 20, vec_id * 20 + 1)"))).collect()
        want = [(20 * i, r, 20 * j) for i, r, j, _ in brute(usable(rows, False), 1, 20)]
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)


def test_few_vectors_go_through_ranges(embeddings, monkeypatch):
    """Also a small table is searched by ranges of the curves, a share of the rows on each."""
    seen, real = [], neighbours._ranges

    def spied(bounds, reaches, asking):
        seen.append((bounds, reaches))
        return real(bounds, reaches, asking)

    monkeypatch.setattr(neighbours, "_ranges", spied)
    rows = embeddings.count()
    neighbours.nearest(embeddings).collect()
    for bounds, reaches in seen:
        ranges, reach = len(bounds[64][0]) + 1, reaches[64]
        assert len(bounds[64]) == neighbours.CURVES and ranges == rows // 21 and 2 * reach + 1 < ranges
    assert neighbours._divisions(500, 20) == (23, 2) and neighbours._divisions(20, 20) == (1, 0) and neighbours._divisions(50, 20) == (2, 1)
    assert neighbours._divisions(10_000, 20) == (64, 3) and neighbours._divisions(10**7, 20)[0] == 640


def test_hilbert_is_a_walk():
    """Neighbours on the curve differ by one step on one axis, and every cell is met once."""
    for d, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = neighbours.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
