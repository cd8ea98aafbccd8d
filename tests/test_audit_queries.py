"""Queries on audits, on tables made for them."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from stepforge.plans import audit_queries


@pytest.mark.parametrize("passages", [10_000, 0])
def test_passages_in_long_documents(spark, tmp_path, monkeypatch, passages):
    """Every count is that of brute force, and a text is split once, not once for each of its words."""
    monkeypatch.setattr(audit_queries, "PASSAGES", passages)
    monkeypatch.setattr(audit_queries, "SHORT_PASSAGES", 2)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (30_000, 500, 500, 7, 6, 0)]
    docs = [*enumerate(texts), (6, None), (7, texts[1]), (8, "  " + texts[3] + "x")]
    cut = lambda t, a, n: t[a : a + n]
    items = [(0, cut(texts[0], 41_003, 90)), (1, cut(texts[1], 100, 40)), (2, texts[3]), (3, "a"), (4, "zz"), (5, ""), (6, None), (7, texts[2] + " a"), (7, cut(texts[2], 9, 60)), (7, cut(texts[2], 9, 60)), (8, cut(texts[0], 50, 4))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = audit_queries.verbatim_containment(spark, str(tmp_path))
    want = Counter(i for i, p in items if p is not None for _, t in docs if t is not None and p in t)
    assert {r.item_id: r.n_docs for r in out.collect()} == dict(want)
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
