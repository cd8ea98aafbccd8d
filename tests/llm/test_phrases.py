"""Removal of repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from stepforge.llm import phrases, words


def brute(rows):
    """(doc_id, n_words, n_removed, hash) for each row."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_documents(documents):
    got = phrases.deduplicated(documents).collect()
    assert key(got) == key(brute([(r.doc_id, r.text) for r in documents.collect()]))
    assert sum(r.n_removed > 0 for r in got) > 5


def test_odd_rows(odd, odd_rows, none):
    assert key(phrases.deduplicated(odd).collect()) == key(brute(odd_rows))
    assert phrases.deduplicated(none).collect() == []


def spliced(seed: int):
    """Documents that share passages of just under, exactly and over 50 words, periodic stretches, copies and repeated ids."""
    rng = random.Random(seed)
    common = [[f"c{p}.{i}" for i in range(n)] for p, n in enumerate((49, 50, 51, 80, 300))] + [["la"] * 120, ["x", "y", "z"] * 40]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [f"u{rng.randint(0, 10**9)}" for _ in range(rng.choice((0, 3, 40, 70)))]
            some = rng.choice(common)
            a = rng.randint(0, len(some) // 2)
            text += some[a : a + rng.randint(len(some) // 2, len(some))]
        rows.append((i // 2 if i > 50 else i - 5, rng.choice((" ", "\n", "  ")).join(text)))
    rows += [(90 + i, rows[7][1] if i < 3 else " ".join(rows[9][1].split())) for i in range(6)] + [(None, rows[7][1]), rows[11], rows[11]]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_spliced(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1000)
    rows = spliced(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert key(phrases.deduplicated(frame).collect()) == key(brute(rows))


def test_automata_are_bounded_and_decide():
    """Passages are dealt to automata of few words, and what these find is what is removed."""
    passages = [(k, " ".join(f"{k}w{i}" for i in range(60)).encode()) for k in range(5)]
    found = list(phrases.automata(passages, most=130))
    assert [len(a.codes) for a in found] == [120, 120, 60]
    text = [f"3w{i}".encode() for i in range(5, 58)]
    assert [a.hits(9, text) for a in found] == [[], [0, 1, 2, 3], []]
    assert [a.hits(3, text) for a in found] == [[], [], []]


def test_every_window_holds_a_phrase():
    for n in range(50, 130):
        starts = range(0, n - phrases.PHRASE + 1, phrases.PHRASE)
        assert all(any(i <= s and s + phrases.PHRASE <= i + 50 for s in starts) for i in range(n - 49))


def test_runs_of_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 42, 43, 44, 200):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        assert words.least_of_runs(x, 43).tolist() == [int(x[i : i + 43].min()) for i in range(n - 42)]
        assert len(words.run_hashes(x, 43)) == max(0, n - 42)
    twice = np.concatenate([x, x])
    a = words.run_hashes(twice, 50)
    assert (a[:151] == a[200:]).all() and len(set(a.tolist())) == 200


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, text), (2, "before " + text + " after")]
    got = phrases.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}[2] == (300_002, 300_000, hashlib.sha256(b"before after").hexdigest())
