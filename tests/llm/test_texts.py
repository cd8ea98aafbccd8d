"""Operators on texts against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stepforge.llm import language, near_dups, packing, personal_data, pieces, pretokens, sharding, token_counts, toxicity
from stepforge.llm.registry import tokenizer

NASTY = ["a", "B", "the", " ", "  ", "\n", "\t", "é", "é", "Σ", "ΑΣ", "'s", "'re", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "🙂", "!!", "...", " ", "\x1c", "\x85", "\0", "İ", "ß", "ﬁ", "_", "\U0010ffff", "\r\n", "▁", "<0x0A>", "<s>"]


def nasty(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(NASTY) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def brute_components(texts: dict[int, str | None]) -> tuple[dict[int, int], dict[int, int]]:
    sets, parent, held = {}, {i: i for i in texts}, defaultdict(list)

    def top(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sorted(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        common = Counter(j for s in sets[i] for j in held[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            held[s].append(i)
    return {i: top(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(documents):
    got = near_dups.near_duplicates(documents).collect()
    expected, sizes = brute_components({r.doc_id: r.text for r in documents.collect()})
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd(odd, none):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == 4
    assert [comp[i] for i in (5, 6, 7, 8, 9, 10)] == [5, 6, 7, 8, 8, 10]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dups.near_duplicates(none).collect() == []
    kept = near_dups.first_of_each(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[1] == 1


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_without_hub(spark, monkeypatch, block):
    """Documents that share bands with a hub they are not linked to still find each other."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(400), 9):
            words[k] = f"n{i}_{k}"
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame).collect()} == brute_components(texts)[0]


@pytest.mark.parametrize("main", [2, 3, 9])
def test_left_over_members_meet_in_blocks(spark, main):
    """Links that only the comparison in blocks can find, between the largest component and others, and among others."""
    words = [f"a{i}" for i in range(300)]
    texts = {1: " ".join(words), 2: " ".join([*words[:200], *[f"z{i}" for i in range(100)]]), 3: " ".join([*words[:200], *[f"z{i}" for i in range(99)], "q"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    reps = near_dups.sketches(docs).select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    columns = "bucket long, band int, rep long, comp long, mains int, others int, main boolean, block int"
    open_ = spark.createDataFrame([(7, b, r, r, 2, 3, r == main, r % 2) for r in (2, 3) for b in range(near_dups.BANDS)], columns)
    assert [tuple(r) for r in near_dups._left_over(open_, reps, docs, 75).collect()] == [(2, 3)]
    apart = open_.filter(F.col("rep") != main)
    assert near_dups._left_over(apart.withColumn("comp", F.lit(5).cast("long")), reps, docs, 75).collect() == []


def test_rows_that_repeat_an_id(spark):
    """They are one document, linked by any of its texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (2, b), (7, a), (9, c), (9, c), (1, "")]
    got = Counter((r.doc_id, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got.values()) == 7 and set(got) >= {(7, 2), (2, 2), (9, 9), (1, 1)} and got[9, 9] == 2 and {c for (i, c) in got if i == 5} == {2}


def test_register_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    x = near_dups.registers([np.unique(a), np.unique(b)])
    estimate = near_dups.corrected(np.array([(x[0] == x[1]).mean()]), np.array([4000]), np.array([4000]))[0]
    assert abs(estimate - 3500 / 4500) < 5 * np.sqrt(0.78 * 0.22 / near_dups.REGISTERS)
    assert near_dups.chance(np.array([1000]), np.array([1000]))[0] < 0.001


def test_components(spark):
    rng = random.Random(2)
    links = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a != b] + [(i, i + 1) for i in range(100, 130)]
    parent = {i: i for link in links for i in link}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = near_dups.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.comp for r in got} == {i: top(i) for i in parent} and len(got) == len(parent)
    assert near_dups.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_token_counts(spark, documents, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame(list(enumerate(nasty(500, 1))), "doc_id long, text string")
    for frame in (documents, odd, extra):
        texts = Counter((r.doc_id, r.text) for r in frame.collect())
        want = Counter()
        for (i, t), n in texts.items():
            size = len(library.encode(t or "", add_special_tokens=False).ids)
            want[i, len((t or "").encode()), size, size > 1024] += n
        assert Counter(tuple(r) for r in token_counts.token_counts(frame, path).collect()) == want
    assert token_counts.token_counts(none, path).collect() == []


def test_frequencies_and_forgetting():
    """Frequencies of pre-tokens by brute force, and equal counts from a vocabulary that keeps forgetting."""
    path = tokenizer("byte_bpe_50k.json")
    texts = pa.array([*nasty(200, 4), "a b a  a", "", "it's it's it"])
    known = pretokens.Vocabulary(path, words=False, counts=True)
    owner, code, n = token_counts.frequencies(known, texts)
    names = list(known.pretokens)
    got = {(o, names[c]): k for o, c, k in zip(owner.tolist(), code.tolist(), n.tolist(), strict=True)}
    assert got == {(i, p): k for i, t in enumerate(texts.to_pylist()) for p, k in Counter(known.pre.split(t)).items()}
    small = pretokens.Vocabulary(path, words=False, counts=True, most=20)
    parts = [token_counts.slice_counts(small, texts[i : i + 10]) for i in range(0, len(texts), 10)]
    assert np.concatenate(parts).tolist() == token_counts.slice_counts(known, texts).tolist()
    assert len(small.units) < len(known.units)


def test_packing(spark, documents, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(nasty(300, 2))], "doc_id long, text string")
    for frame in (documents, odd, extra):
        rows = packing.packed_documents(frame, path).collect()
        want = Counter()
        for r in frame.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
            for k in range(0, len(ids), 4096):
                want[r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            end = 0
            for at, n in sorted(own):
                assert at == end
                end = at + n
            assert end <= 4096
        assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.packed_documents(none, path).collect() == []


def placed(plan, counts, capacity):
    """The number of bins of a plan that holds just the given pieces."""
    held = Counter()
    for content, n in plan:
        assert n > 0 and 0 < sum(x * k for x, k in content.items()) <= capacity and all(k > 0 for k in content.values())
        held.update({x: k * n for x, k in content.items()})
    assert held == Counter(counts)
    return sum(n for _, n in plan)


def fewest(lengths, capacity):
    """Bins of the best packing, by trying every one."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_packing_by_groups(spark, monkeypatch):
    """Several groups of one composition and what is left over: every piece once, gapless offsets and sequence numbers."""
    from stepforge.llm.common import kept

    monkeypatch.setattr(packing.planned, "__defaults__", (40,))
    rng = random.Random(1)
    lengths, seen = [rng.randint(20, 60) for _ in range(1200)], Counter()
    rows = [(i, 0, 0, n, i, i % 3, seen.update([(n, i % 3)]) or seen[n, i % 3] - 1) for i, n in enumerate(lengths)]
    frame = kept(spark.createDataFrame(rows, f"{packing.PIECE}, part int, nth long"), "test-pieces")
    got = packing.pack(frame, capacity=100).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    assert sorted(bins) == list(range(len(bins))) and len(bins) <= 1.1 * sum(lengths) / 100
    for own in bins.values():
        assert [a for a, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 100


@pytest.mark.parametrize("seed", range(6))
def test_no_step_is_left(seed):
    """A second search on the result of the first changes nothing, whatever the lengths."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(*((10, 60), (300, 1400), (1, 4000), (1200, 2100), (700, 900), (1, 300))[seed], 3000)
    capacity = 100 if seed == 0 else 4096
    once = packing.local_search(packing.best_fit(dict(Counter(lengths.tolist())), capacity), capacity)
    again = packing.local_search(once, capacity)
    assert sum(n for _, n in again) == sum(n for _, n in once)
    assert sum(n * sum(x * k for x, k in c.items()) ** 2 for c, n in again) == sum(n * sum(x * k for x, k in c.items()) ** 2 for c, n in once)


@pytest.mark.parametrize("seed", range(20))
def test_plans_beside_the_best(seed):
    """At most one bin more than the best packing of few pieces, and never more than best fit alone."""
    rng = random.Random(seed)
    lengths = [rng.randint(15, 70) for _ in range(13)]
    counts = dict(Counter(lengths))
    first = packing.best_fit(counts, 100)
    n = placed(packing.local_search(first, 100), counts, 100)
    assert n <= placed(first, counts, 100) and n <= fewest(lengths, 100) + 1


@pytest.mark.parametrize(("low", "high", "most"), [(2100, 3000, 60_000), (1000, 2000, 23_700), (1, 600, 4_500)])
def test_plans_of_many_pieces(low, high, most):
    """Also where no two pieces fit together; and what a plan takes does not follow the number of pieces."""
    lengths = np.random.default_rng(1).integers(low, high, 60_000).tolist()
    counts = dict(Counter(lengths))
    assert placed(packing.planned(counts, 4096), counts, 4096) <= most
    large = {n: k * 10**9 + n % 7 for n, k in counts.items()}
    plan = packing.planned(large, 4096, group=20_000)
    assert placed(plan, large, 4096) <= most * 10**9 * 1.01 and len(plan) < 30_000


def test_two_for_one_swaps():
    """Best fit needs three bins; two short pieces for a longer one make it two, which no move or single exchange does."""
    start = [({5: 1, 3: 1}, 1), ({6: 1, 2: 1}, 1), ({2: 2}, 1)]
    assert sum(n for _, n in packing.local_search(start, 10)) == 2
    assert packing.local_search([], 10) == [] and packing.planned({}, 10) == []


def test_pieces(spark, documents, odd, none):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    spaced = ["".join(rng.choice(["a", "the", "Hello", "1", "\n", "日本"]) + " " * rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 40]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    extra = spark.createDataFrame(list(enumerate([*nasty(500, 3), *spaced, " " * 200_000, "x" + " " * 100_000 + "y"])), "doc_id long, text string")
    for frame in (documents, odd, extra):
        rows = pieces.encoded(frame, path)
        got = rows.collect()
        assert [r.ids for r in got] == library.encode([r.text or "" for r in got], num_threads=1)
        back = Counter((r.doc_id, r.text) for r in pieces.decoded(rows, path).collect())
        assert back == Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in got)
        assert all(r.round_trip for r in pieces.piece_digest(frame, path).collect())
    assert pieces.encoded(none, path).collect() == []


_LONG = """
import resource, sys
sys.path.insert(0, {root!r})
import pyarrow as pa, sentencepiece
from stepforge.llm import pieces
path = {path!r}
model, library = pieces.loaded(path), sentencepiece.SentencePieceProcessor(model_file=path)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
texts = [" " * 2_000_000, "日本語の" * 170_000, "ab" * 500_000 + "é" * 100, *["x" * k + " " * (9_000 + k) for k in range(40)]]
for text, ids in zip(texts, model.encode(pa.array(texts)), strict=True):
    assert ids.tolist() == library.encode(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_very_long_units_in_bounded_memory():
    """2 MB of spaces, 2 MB of CJK, a megabyte of letters and many long runs of spaces equal the library below 600 MB."""
    code = _LONG.format(root=str(Path(pieces.__file__).parents[2]), path=tokenizer("piece_bpe_32k.model"))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout) < 600


def test_windows_of_a_long_unit(monkeypatch):
    """Cut anywhere, windows give what one index gives."""
    model = pieces.loaded(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = ["▁" + "".join(rng.choice(["the", "ing", "日", "e", "x", "▁", "▁▁▁", "é", "1"]) for _ in range(120)) for _ in range(40)]
    want = model.encode_units(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(pieces, "WINDOW", size)
        assert model.encode_units(texts) == want


def test_piece_edges_are_all_occurrences():
    model = pieces.loaded(tokenizer("piece_bpe_32k.model"))
    text = "▁the▁there\0▁ththe"
    ends, starts, ids = model.edges(text)
    own = set(model.piece_ids.tolist())
    want = {(b, a, model.rank[text[a:b]][1]) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 16) + 1) if text[a:b] in model.rank and model.rank[text[a:b]][1] in own}
    assert set(zip(ends.tolist(), starts.tolist(), ids.tolist(), strict=True)) == want
    assert ends.tolist() == sorted(ends.tolist())


@pytest.mark.parametrize("n", [40, 7])
def test_sharding(documents, odd, none, n):
    for frame in (documents, odd):
        rows = sharding.shuffled_shards(frame, n, bucket_bytes=20_000).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in frame.collect())
        slots = defaultdict(list)
        for r in rows:
            assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(n)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        again = sharding.shuffled_shards(frame, n, bucket_bytes=20_000).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sharding.shuffled_shards(none, n).collect() == []


def test_sharding_by_brute_force(spark, documents):
    """The same order row by row: scattered by the hash, each bucket shuffled from its last row down, dealt in ranges."""
    seed, most, shards = sharding.SEED, 30_000, 7
    rows = documents.withColumn("place", F.monotonically_increasing_id()).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "place")).collect()
    buckets = -(-sum(len(r.text.encode()) + 16 for r in rows) // most)
    order = []
    for b in range(buckets):
        own = sorted((r for r in rows if r.hash % buckets == b), key=lambda r: (r.hash, r.place))
        order += [own[i] for i in sharding.fisher_yates(len(own), seed, b)]
    want, slots = [], Counter()
    for p, r in enumerate(order):
        s = p * shards // len(order)
        want.append((r.doc_id, s, slots[s]))
        slots[s] += 1
    got = sharding.shuffled_shards(documents, shards, seed, most).select("doc_id", "shard", "slot").collect()
    assert buckets > 3 and sorted(map(tuple, got)) == sorted(want)


def test_write_shards(spark, documents, none, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_ROWS", 50)
    rows = sharding.shuffled_shards(documents, 3)
    sharding.write_shards(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 3
    for s in range(3):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        slots = [x for f in files for x in pq.read_table(f, columns=["slot"])["slot"].to_pylist()]
        assert len(files) > 1 and slots == list(range(len(slots)))
    sharding.write_shards(sharding.shuffled_shards(none, 3), str(tmp_path / "none"))


def brute_spans(text: str) -> str:
    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_base_spans_random():
    rng = random.Random(6)
    alphabet = ["a", "b.c", "@", "@", ".", "-", "_", "+", "1", "25", "255", "256", "1.2.3.4", " ", "(", ")", "4539 1488 0343 6467", "é", "+1 (017) 555-7713", "%", "00"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 18)))
        assert personal_data.written(personal_data.base_spans(text)) == brute_spans(text), text


def test_private_digest(documents, odd, none):
    for frame in (documents, odd):
        got = Counter((r.doc_id, r.base_sha256) for r in personal_data.private_digest(frame).collect())
        assert got == Counter((r.doc_id, hashlib.sha256(brute_spans(r.text or "").encode()).hexdigest()) for r in frame.collect())
    assert personal_data.private_digest(none).collect() == []
    clean = personal_data.sanitised(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.filter("doc_id = 15").first().text == "mail me at [EMAIL] or [PHONE] now"
    assert clean.filter("doc_id = 6").first().text is None


def test_revealing_terms(spark):
    """A term near one address in four documents gives it away, also where the address is missing; a common term does not."""
    rows = [(i, f"filler{i} common zanzibar contact joe@site.example.com again") for i in range(4)]
    rows += [(i, f"filler{i} common text without anything of note") for i in range(4, 400)]
    rows += [(400, "only zanzibar é zanzibar here")]
    got = {r.doc_id: r.spans for r in personal_data.private_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[400] == "term:5:13,term:16:24"
    assert got[0].startswith("email:32:52,") and "term:15:23" in got[0] and "term:8:14" not in got[0]
    assert got[5] == ""
    clean = personal_data.sanitised(spark.createDataFrame(rows, "doc_id long, text string"))
    assert clean.filter("doc_id = 400").first().text == "only [WORD NEAR EMAIL] é [WORD NEAR EMAIL] here"


def brute_sensitive(texts):
    """term: (disclosure, removed, kind), by counting documents."""
    term, entities, beside, whole = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+"), [], [], []
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    for text in texts:
        spans = personal_data.base_spans(text)
        entities.append({personal_data._entity(text, s) for s in spans})
        found = [m for m in term.finditer(text)]
        beside.append({low(m[0]) for m in found if not any(m.start() < b and a < m.end() for _, a, b in spans)})
        whole.append({low(m[0]) for m in found})
    n_term, n_entity = Counter(t for w in whole for t in w), Counter(e for own in entities for e in own)
    n_near = Counter((t, e) for own, w in zip(entities, beside, strict=True) for t in w for e in own)
    out = {}
    for (t, e), near in n_near.items():
        share, alone = near / n_term[t], n_entity[e] / len(texts)
        bits = np.log2(share / alone)
        rest = (1 - share) * np.log2((1 - share) / (1 - alone)) if share < 1 and alone < 1 else 0.0
        frequent = alone < 1 and bits >= -0.75 * np.log2(alone) and n_term[t] * (share * bits + rest) >= 18
        if near >= 3 and share >= 0.5 and (bits >= 6 or frequent):
            out[t] = max(out.get(t, (0, 0)), (share, e))
    return {t: (share, share >= 0.9, e & 3) for t, (share, e) in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_disclosure_by_brute_force(spark, seed):
    """Random documents with names, numbers and nicknames beside addresses and phones; shares at and about the thresholds, ties, repeated rows, empty texts."""
    rng = random.Random(seed)
    people = [(f"p{i}@site.example.com", f"+1 (017) 555-{1000 + i}", [f"Name{i}", f"{7000 + i}", f"nick{i}x", f"Ömer{i}"]) for i in range(6)]
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "12", "é"]) for _ in range(6)) for _ in range(500)]
    for n, (mail, phone, hints) in enumerate(people):
        for hint in hints:
            near, apart = rng.choice([(2, 0), (3, 0), (3, 1), (3, 3), (3, 4), (9, 1), (10, 0), (5, 5)])
            texts += [f"{hint} wrote alpha {mail if n % 2 else phone} today" for _ in range(near)] + [f"met {hint} and {hint.upper()} beta" for _ in range(apart)]
    texts += [f"common zanzibar {people[0][0]} {k}" for k in range(150)] + ["zanzibar alone", "", " ", texts[-1], texts[-1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_sensitive(texts)
    assert len({x[1] for x in want.values()}) == 2 and len({x[2] for x in want.values()}) == 2
    got = {r.doc_id: r for r in personal_data.private_spans(frame).collect()}
    clean = {r.doc_id: r.text for r in personal_data.sanitised(frame).collect()}
    for i, text in enumerate(texts):
        own = personal_data.base_spans(text)
        terms = []
        for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text):
            of = want.get(re.sub("[A-Z]", lambda c: c[0].lower(), m[0]))
            if of and not any(m.start() < b and a < m.end() for _, a, b in own):
                terms.append((m.start(), m.end(), of[1], of[2]))
        assert [tuple(t) for t in got[i].terms] == terms
        marks = [(a, b, f"[{personal_data.KINDS[k].upper()}]") for k, a, b in own] + [(a, b, "" if gone else personal_data.generalised(text[a:b], kind)) for a, b, gone, kind in terms]
        for a, b, mark in sorted(marks, reverse=True):
            text = text[:a] + mark + text[b:]
        assert clean[i] == text


def test_generalised():
    assert [personal_data.generalised(t, k) for t, k in (("4711", 0), ("a1", 1), ("Joe", 2), ("zanzibar", 3))] == ["[NUMBER NEAR EMAIL]", "[CODE NEAR IP]", "[NAME NEAR CARD]", "[WORD NEAR PHONE]"]


@pytest.mark.parametrize("columns", [("_spans", "_terms", "_gone", "_again", "_key", "_id"), ("spans", "terms", "row", "key", "own", "id", "own_id", "hash", "new", "kept", "a.b")])
def test_clashing_columns(spark, columns):
    """Whatever other columns are called, they come out as they went in."""
    rows = [(1, "mail joe@site.example.com " * 3, *columns), (2, "mail joe@site.example.com " * 3, *columns), (3, None, *columns), (1, "other text here", *columns), (1, "other text here", *columns)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *columns])
    clean = personal_data.sanitised(frame)
    assert clean.columns == frame.columns and sorted(map(repr, clean.collect())) == sorted(repr(r).replace("joe@site.example.com", "[EMAIL]") for r in frame.collect())
    left = near_dups.first_of_each(frame)
    assert left.columns == frame.columns and sorted((r.doc_id, r[2:]) for r in left.collect()) == [(1, columns), (3, columns)]
    assert len({r.text for _ in range(2) for r in near_dups.first_of_each(frame.repartition(3)).filter("doc_id = 1").collect()}) == 1


def test_revealing_terms_far_away(spark):
    """Terms count wherever they stand in a document, near in some and far in others, also short and digit-led ones."""
    far = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"zanzibar Li 4711x {'' if i < 2 else far} mail joe@site.example.com") for i in range(6)]
    rows += [(i, f"mail {far} of others") for i in range(6, 600)]
    rows += [(600, "Li met zanzibar at 4711x of mail")]
    got = {r.doc_id: r.spans for r in personal_data.private_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[600] == "term:0:2,term:7:15,term:19:24"
    assert got[5].endswith(",term:0:8,term:9:11,term:12:17") and got[6] == ""


def test_revealing_terms_of_a_frequent_entity(spark):
    """The contact address of a third of the documents, whose name gives it away; an entity of all documents tells nothing."""
    rows = [(i, "common zanzibar writes joe@site.example.com" if i % 3 == 0 else f"common text {i}") for i in range(90)]
    rows += [(90, "only zanzibar common")]
    got = {r.doc_id: r.spans for r in personal_data.private_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90] == "term:5:13" and got[1] == ""
    assert got[0] == "email:23:43,term:7:15,term:16:22"
    every = [(i, "common joe@site.example.com") for i in range(90)]
    got = personal_data.private_digest(spark.createDataFrame(every, "doc_id long, text string")).collect()
    assert {r.spans for r in got} == {"email:7:27"}


def test_language(documents, odd, none):
    got = {r.doc_id: r for r in language.language_digest(documents).collect()}
    truth = {r.doc_id: r for r in documents.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].lang_pred == truth[i].lang for i in held]) > 0.95
    assert not any(r.rejected for r in got.values())
    rows = language.identified(odd)
    assert rows.select("row.*").columns == odd.columns and rows.count() == odd.count()
    und = {r.row.doc_id for r in rows.collect() if r.lang_pred == "und"}
    assert und == {5, 6, 7, None} and all(r.rejected for r in rows.filter("lang_pred = 'und'").collect())
    assert language.language_digest(none).collect() == []


def test_language_rejects(spark, documents):
    """Texts of no learned language go, short and long ones; all of the documents stay."""
    rng = random.Random(5)
    foreign = {
        "fi": "Suomen kieli kuuluu uralilaisiin kieliin ja sitä puhuu noin viisi miljoonaa ihmistä pääasiassa Suomessa. Talvella järvet jäätyvät ja lumi peittää metsät. ",
        "tr": "Türkçe, Türkiye'de ve komşu ülkelerde yaşayan milyonlarca insanın konuştuğu bir dildir. Bugün hava çok güzel, çocuklar sokakta oynuyor. ",
        "ru": "Русский язык относится к восточной группе славянских языков и является одним из самых распространённых языков мира. ",
        "zh": "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20_000)),
        "consonants": "".join(rng.choice("bcdfghjklmnpqrstvwxz    ") for _ in range(20_000)),
        "base64": "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(20_000)),
    }
    rows = [(f"{name} {n}", (text * (n // len(text) + 1))[:n]) for name, text in foreign.items() for n in (100, 400, 4_000, 20_000)]
    model = language.fit(documents)
    got = language.identified(spark.createDataFrame(rows, "name string, text string"), model).filter("not rejected").collect()
    assert [(r.row.name, r.score) for r in got] == []
    assert language.identified(documents, model).filter("rejected and row.text rlike '[a-z]'").count() == 0


def test_language_without_labels(spark):
    rows = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in language.language_digest(rows).collect()] == [("und", True)]


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    score, toxic = np.array([got[i].score for i in held]), np.array([truth[i] for i in held])
    bins = np.digitize(score, [0.05, 0.3, 0.7, 0.95])
    assert sum(abs(score[bins == b].sum() - toxic[bins == b].sum()) for b in set(bins)) / len(held) < 0.05
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(odd, labels, model)
    assert rows.select("row.*").columns == odd.columns and all(0 <= r.score <= 1 for r in rows.collect())
    assert toxicity.toxicity_digest(none, labels).collect() == []
    some = toxicity.toxicity_digest(odd, labels.limit(0)).collect()
    assert len(some) == odd.count() and {r.score for r in some} == {0.0}


def test_lexica_know_nothing_of_their_own_fold(spark):
    """A word of one fold's toxic texts alone is in the lexicon of all, and in those of the other folds' texts, but not in its own."""
    rows = [("zap bad", 1, 0)] * 8 + [("bad", 1, 1)] * 8 + [("bad", 1, 2)] * 8 + [("good", 0, f) for f in range(3)] * 8
    sample = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int, fold int")
    totals = Counter((f, t) for _, t, f in rows)
    entries = toxicity.entry_counts(sample).cache()
    assert {r.entry: (r.p, r.q) for r in entries.filter("not stem and fold = 0").collect()} == {"zap": (8, 0), "bad": (8, 0), "good": (0, 8)}
    lexica = {f: toxicity.learned_lexicon(entries, totals, f).words for f in (None, 0, 1, 2)}
    assert ["zap" in lexica[f] for f in (None, 0, 1, 2)] == [True, False, True, True] and all("bad" in w for w in lexica.values())
    assert toxicity.learned_lexicon(entries.filter("q > 100"), {}).words == {}


def test_isotonic():
    at, value = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.interp([1, 2, 3, 4], at, value).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.Trees(rounds=30, depth=3).fit(x[:1500], y[:1500], np.ones(1500)).raw(x[1500:])
    assert ((raw > 0) == (y[1500:] > 0.5)).mean() > 0.95


def test_slices_hold_whole_rows():
    from stepforge.llm.common import text_slices

    rng = random.Random(0)
    rows = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 50, 400]) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 37], pa.string())], names=["text"]) for i in range(0, 300, 37)]
    out = list(text_slices(iter(batches), limit=200, rows=20))
    assert [t for b in out for t in b.column("text").to_pylist()] == rows
    assert all(sum(len(t or "") for t in b.column("text").to_pylist()) <= 200 or b.num_rows == 1 for b in out)
    assert max(b.num_rows for b in out) <= 20


def test_grams_and_cosines_by_brute_force(documents):
    texts = [r.text for r in documents.limit(40).collect()] + ["  Ab, cd1e", "", None, "x", " 12 ", "ÄÖ ßß"]

    def grams(text):
        plain = "".join(c if c.isalpha() else " " for c in (text or "").lower() + " ")
        plain = re.sub(" +", " ", plain).lstrip()
        return Counter(plain[k : k + n] for n in language.GRAMS for k in range(len(plain) - n + 1))

    counts, has = language.gram_counts(texts)
    for i, text in enumerate(texts):
        one, _ = language.gram_counts([text])
        own = counts.owner == i
        assert (one.cell.tolist(), one.n.tolist()) == (counts.cell[own].tolist(), counts.n[own].tolist())
        assert one.n.sum() == sum(grams(text).values()) and has[i] == any(c.isalpha() for c in text or "")
        if text and len(text) < 20:
            assert sorted(one.n.tolist()) == sorted(grams(text).values())
    model = language.fit(documents)
    at, score = model.nearest(counts)
    for i in np.flatnonzero(has):
        v = np.zeros(1 << language.DIM_BITS)
        for cell, n in zip(counts.cell[counts.owner == i], counts.n[counts.owner == i], strict=True):
            v[cell] = np.log(1 + n) * model.idf[cell]
        cosines = [float(v @ c) / float(np.sqrt(v @ v)) for c in model.centers]
        assert abs(max(cosines) - score[i]) < 1e-4 and model.owner[int(np.argmax(cosines))] == at[i]
    assert all(abs(float(c @ c) - 1) < 1e-4 for c in model.centers) and max(np.bincount(model.owner)) <= language.CENTROIDS


def test_toxic_features_and_trees_by_brute_force(documents):
    lexicon = toxicity.Lexicon({"idiot": 2.0, "fool": 1.6}, {"idio": 1.8})
    texts = ["You are an IDIOT!", "1d1ot fool, you", "fool a b c d e you", "", "Fine weather\ttoday", "vous! tu @fool idiots ABC"] + [r.text for r in documents.limit(20).collect()]
    got = toxicity.features(toxicity.Units(lexicon), pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        words = re.sub(r"[\t\n\v\f\r]", " ", text).split(" ")
        cores = [toxicity.core(w) for w in words]
        hit = [max(lexicon.weights(c)) > 0 for c in cores]
        you = [c in toxicity.SECOND_PERSON for c in cores]
        n = max(1, sum(map(bool, words)))
        letters, digits = sum(c.isalpha() for c in text), sum(c.isdigit() for c in text)
        want = {
            "hits": sum(hit), "hit_density": sum(hit) / n, "you_density": sum(you) / n, "exclaim_density": text.count("!") / n, "log_units": np.log1p(n),
            "near_you": sum(h and any(you[max(0, k - toxicity.NEAR) : k] + you[k + 1 : k + 1 + toxicity.NEAR]) for k, h in enumerate(hit)),
            "upper_share": sum(c.isalpha() and c.isupper() for c in text) / max(1, letters), "digit_share": digits / max(1, sum(map(len, words))),
            "word_sum": sum(lexicon.weights(c)[0] for c in cores), "hidden_most": max(lexicon.weights(c)[2] for c in cores),
        }
        for name, value in want.items():
            assert abs(row[toxicity.FEATURES.index(name)] - value) < 1e-5, (text, name)
    rng = np.random.default_rng(3)
    x = np.round(rng.random((300, 4)), 1)
    trees = toxicity.Trees(rounds=8, depth=3).fit(x, (x[:, 0] > x[:, 1]).astype(float), np.ones(300))
    for row, raw in zip(x, trees.raw(x), strict=True):
        total = trees.base
        for axis, cut, value in trees.trees:
            node = 0
            while node < len(axis):
                edges = trees.edges[axis[node]]
                node = 2 * node + 1 + (sum(e < row[axis[node]] for e in edges) > cut[node])
            total += value[node - len(axis)]
        assert abs(total - raw) < 1e-9


def test_sanitised_and_first_of_each_without_rows(none):
    for f in (personal_data.sanitised, near_dups.first_of_each):
        out = f(none)
        assert out.columns == none.columns and out.collect() == []
