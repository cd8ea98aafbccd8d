"""The divergence audit against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from stepforge.llm import divergence


def brute(rows, least=30, ranks=50):
    """rows: (text, lang, source)"""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    seen = Counter((lang, w) for lang, _, words in docs for w in set(words))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((w for (of, w), n in seen.items() if of == lang and n >= least), key=lambda w: w.encode())
        count = {s: Counter() for of, s, _ in docs if of == lang}
        for of, s, words in docs:
            if of == lang:
                count[s].update(w for w in words if seen[lang, w] >= least)

        def shares(c, kept=kept):
            n = sum(c.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // n for w in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(sum(count.values(), Counter()))
        for s in p:
            pairs = sorted((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode()) for t in p if t != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:ranks]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, source string, item string, n string")


def test_documents(documents):
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    assert sorted(map(tuple, divergence.audited(documents).collect())) == sorted(brute(rows))


def test_odd_rows(odd, odd_rows, none):
    rows = [(r[1], r[2], r[3]) for r in odd_rows]
    assert sorted(map(tuple, divergence.audited(odd, least=2).collect())) == sorted(brute(rows, 2))
    assert divergence.audited(none).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_ties_shards_and_flushes(spark, monkeypatch, seed):
    """Few rows a shard, counts handed on early, equal values, sources without terms, upper case beyond ASCII, nulls."""
    monkeypatch.setattr(divergence, "SHARD_ROWS", 20)
    monkeypatch.setattr(divergence, "HELD", 3)
    rng = random.Random(seed)
    terms = ["a", "A", "Ä", "ä", "b1c", "d'e", "é", "日本", "zz", "Zz", "\x7f", "\x85", "x\0y"]
    rows = [(rng.choice((None, "", " ", *[" ".join(rng.choices(terms, k=5))] * 8)), rng.choice(("en", "fr", None, "")), rng.choice(("s", "t", "u", None, "é", "Z"))) for _ in range(200)]
    rows += [("once only", "xx", "s"), (None, "xx", "t"), (None, "yy", "s")]
    got = divergence.audited(made(spark, rows), least=4, ranks=3).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 3))


def test_very_long_text(spark):
    rows = [("the cat " * 200_000, "en", "a"), ("the dog", "en", "b")]
    assert sorted(map(tuple, divergence.audited(made(spark, rows), least=1).collect())) == sorted(brute(rows, 1))
