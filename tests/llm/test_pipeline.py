"""The pipeline's stages, each on what its predecessor kept."""

from __future__ import annotations

import importlib.util
from collections import Counter

import pytest
from tokenizers import Tokenizer

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

from stepforge.llm.common import kept
from stepforge.llm.registry import tokenizer


def test_stages(spark):
    from test_texts import brute_components

    sf_dir = "/root/testdata/sf0.01"  # the smallest tables with enough labels to learn from
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, out := kept(stage(spark, docs, sf_dir), f"test-{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents.columns
        docs = out
    before, after = seen["near_duplicates"]
    comps, _ = brute_components({r.doc_id: r.text for r in before.collect()})
    assert {r.doc_id for r in after.collect()} == {i for i, c in comps.items() if i == c}
    before, after = seen["language"]
    assert before.count() == after.count()
    before, after = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(gone & toxic) >= 0.7 * len(toxic) and len((gone & labelled) - toxic) <= 0.02 * len(labelled)
    before, after = seen["personal_data"]
    assert before.count() == after.count() and after.filter("text rlike '[a-z]@[a-z]' or n_chars <> length(text)").count() == 0
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    own, bins = Counter(), {}
    for r in after.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own[r.doc_id] += r.length
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    assert own == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    assert all([a for a, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096 for b in bins.values())
    assert len(bins) <= -(-sum(own.values()) // 4096) + 1


def test_without_rows(spark, sf_dir, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"none-{name}")
        assert docs.collect() == []


def test_odd_rows(spark, sf_dir, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"odd-{name}")
    left = {r.doc_id for r in docs.collect()}
    # odd texts that no learned language has go first; of copies and near copies one stays
    assert left and not left & {2, 3, 5, 6, 7}
