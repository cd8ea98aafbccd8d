"""Places and firsts of groups against sorting in Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stepforge.operators import ranking, splits


def hashed(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize(("digits", "most"), [(4, 100_000), (1, 3), (1, 1)])
def test_classes_by_histograms(spark, monkeypatch, digits, most):
    """A hot group, small and null ones; cuts of nothing, of all and within one bin; bins that have to be looked at finer."""
    monkeypatch.setattr(ranking, "DIGITS", digits)
    monkeypatch.setattr(ranking, "BIN_ROWS", most)
    rng = random.Random(digits + most)
    rows = [(i, "hot" if i % 2 else rng.choice(["a", None, "b", f"g{i}"]), i % 3) for i in range(700)]
    got = ranking.classed(spark.createDataFrame(rows, "k int, g string, x int"), ["g"], "k", 5, lambda n: [F.floor(n / 10), F.floor(n / 3), n - 1, n + 4], "c", "n").collect()
    groups = defaultdict(list)
    for k, g, _ in rows:
        groups[g].append(k)
    want = {}
    for g, ks in groups.items():
        n = len(ks)
        for place, k in enumerate(sorted(ks, key=lambda k: (hashed(5, k), k))):
            want[k] = (g, n, sum(place >= c for c in (n // 10, n // 3, n - 1, n + 4)))
    assert {r.k: (r.g, r.n, r.c) for r in got} == want and len(got) == 700
    assert {(r.k, r.x) for r in got} == {(k, x) for k, _, x in rows}


def test_no_rows(spark):
    none = spark.createDataFrame([], "k int, g string")
    assert ranking.classed(none, ["g"], "k", 1, lambda n: [n]).collect() == []
    assert ranking.placed(none, ["k"]).collect() == []
    with pytest.raises(ValueError, match="5 rows asked of 0"):
        splits.exact_holdout(none, ["g"], "k", 5, 1)


def test_places(spark):
    """Also where most rows share the first value, and in descending order."""
    rng = random.Random(2)
    rows = [(rng.choice(["same", "same", "same", "b", None]), rng.randint(0, 50), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "a string, b int, i int").repartition(5)
    got = sorted((r.place, r.i) for r in ranking.placed(frame, [F.desc_nulls_last("a"), F.col("b"), F.col("i")]).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[1], r[2]))
    assert got == [(p, r[2]) for p, r in enumerate(order)]


def test_exact_counts(spark):
    rows = [(i, "big" if i < 700 else f"s{i % 7}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "k int, g string")
    for held in (0, 1, 10, 333, 1000):
        out = splits.exact_holdout(frame, ["g"], "k", held, 3).groupBy("g").agg(F.count_if("held_out").alias("held"), F.count("*").alias("n")).collect()
        assert sum(r.held for r in out) == held and all(abs(r.held - r.n * held / 1000) < 1 for r in out)
    assert splits.exact_holdout(frame, [], "k", 17, 3).filter("held_out").count() == 17
