"""Repeated passages removed by automata of their phrases.

A window is 50 consecutive words; it recurs if documents with different ids hold it. Three steps find all of them.

Confirm. Every window has an anchor, the least hash of its runs of eight words, so equal windows have equal anchors
and a document has about one anchor for 22 words. Anchors that documents with different ids share are looked at closer: their windows
are counted by 128 bits (anchor and window hash), and those that recur are owned by the smallest doc_id. An owner's
recurring windows, taken together in cells of 64 starts, are the confirmed passages: stretches of its text of at most 113 words.

Compile. Documents that hold a recurring anchor are dealt to shards of about a megabyte, and each shard gets the passages
that one of its recurring windows belongs to. A passage is cut into phrases of 25 words; any window of the passage holds
one of them whole. The phrases of a shard become Aho-Corasick automata over words, a word a character.

Stream. All documents of a shard go through its automata. Around each phrase that is found, the windows that hold it
are looked up, word by word, among the windows of the passages; a window that starts in a document with a smaller doc_id marks
its 50 words. So hashes only propose: what is removed was compared as words.

Documents of exactly the same words are one class before any of this: of 50 words and more, all but those with the smallest doc_id
lose all words. No step gathers a group: a passage of a third of all documents is copied once a shard, and its
anchors and windows are summed before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import among, kept, member_bits, ready, settle, text_slices
from stepforge.llm.words import joined, least_of_runs, run_hashes, runs, word_hashes

WINDOW, ANCHOR, PHRASE, CELL = 50, 8, 25, 64
#: UTF-8 bytes of text in a shard, about; words of the passages that one automaton is compiled from.
SHARD_BYTES, AUTOMATON_WORDS = 1 << 20, 200_000
_NOTHING = hashlib.sha256(b"").hexdigest()

ROWS = "doc_id long, n_words long, words_sha256 string, part long, anchors array<long>"
WINDOWS = "doc_id long, part long, at long, anchor long, window long"


def words_of(text: str | None) -> list[bytes]:
    """The runs of bytes other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _digest(words: list[bytes]) -> tuple[str, int]:
    """The hash of the words joined by one space, and its first 64 bits."""
    h = hashlib.sha256(b" ".join(words))
    return h.hexdigest(), int.from_bytes(h.digest()[:8], "big", signed=True)


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a slice of texts: window hashes and anchors by the word where a window starts, and the first and the end of each text's starts."""
    data, bounds = joined(texts)
    starts, ends = runs(data)
    hashes = word_hashes(data, starts, ends, lower=False)
    first = np.searchsorted(starts, bounds)
    grams = run_hashes(hashes, ANCHOR)
    return run_hashes(hashes, WINDOW).view(np.int64), least_of_runs(grams, WINDOW - ANCHOR + 1).view(np.int64), first[:-1], np.maximum(first[1:] - WINDOW + 1, first[:-1])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        texts = part.column("text").to_pylist()
        _, anchors, first, end = _windows(texts)
        words = [words_of(t) for t in texts]
        digests = [_digest(w) for w in words]
        found = [np.unique(anchors[a:b]) for a, b in zip(first, end, strict=True)]
        columns = [part.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([d for d, _ in digests], pa.string()), pa.array([p for _, p in digests], pa.int64()), _lists(found)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "words_sha256", "part", "anchors"])


def _parted(bits: np.ndarray):
    """Rows whose id may be among those of bits, with the part of their words."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            mask = pa.array(among(bits, np.asarray(b.column("hash"))))
            ids, texts = (b.column(c).filter(mask) for c in ("doc_id", "text"))
            parts = [_digest(words_of(t))[1] for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(parts, pa.int64())], names=["doc_id", "text", "part"])

    return keep


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose anchor is one of the document's recurring ones."""
    for part in text_slices(batches):
        windows, anchors, first, end = _windows(part.column("text").to_pylist())
        ids, parts, shared = np.asarray(part.column("doc_id")), np.asarray(part.column("part")), part.column("anchors")
        at, row = [], []
        for i, (a, b) in enumerate(zip(first, end, strict=True)):
            hit = np.flatnonzero(np.isin(anchors[a:b], np.asarray(shared[i].values)))
            at.append(hit)
            row.append(np.full(len(hit), i))
        if at:
            at, row = np.concatenate(at), np.concatenate(row)
            place = first[row] + at
            columns = [ids[row], parts[row], at, anchors[place], windows[place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "part", "at", "anchor", "window"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each passage of a document, given by its cell and the first and last start of a recurring window."""
    for part in text_slices(batches):
        out: list[tuple] = []
        for doc_id, of, text, cells in zip(*(part.column(c).to_pylist() for c in ("doc_id", "part", "text", "cells")), strict=True):
            words = words_of(text)
            out += [(doc_id, of, c["cell"], b" ".join(words[c["low"] : c["high"] + WINDOW])) for c in cells]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["owner", "owner_part", "cell", "words"])


class Automaton:
    """The phrases of passages, and whose windows they hold: (doc_id, words) each."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]) -> None:
        self.codes: dict[bytes, str] = {}
        self.owners: dict[str, int] = {}
        self.phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for doc_id, words in passages:
            line = "".join([self.codes.setdefault(w, self._character(len(self.codes) + 1)) for w in words])
            for i in range(len(line) - WINDOW + 1):
                window = line[i : i + WINDOW]
                self.owners[window] = min(doc_id, self.owners.get(window, doc_id))
            for i in range(0, len(line) - PHRASE + 1, PHRASE):
                self.phrases.add_word(line[i : i + PHRASE], 1)
        self.phrases.make_automaton()

    @staticmethod
    def _character(n: int) -> str:
        return chr(n if n < 0xD800 else n + 0x800)  # no surrogates; 0 is for words that no passage has

    def hits(self, doc_id: int, words: list[bytes]) -> list[int]:
        """Where windows start that also start in a passage of a smaller doc_id."""
        line, out, done = "".join([self.codes.get(w, "\0") for w in words]), [], 0
        for end, _ in self.phrases.iter(line):
            last = min(end - PHRASE + 1, len(line) - WINDOW)
            for i in range(max(done, end - WINDOW + 1), last + 1):
                if self.owners.get(line[i : i + WINDOW], doc_id) < doc_id:
                    out.append(i)
            done = max(done, last + 1)
        return out


def automata(passages: list[tuple[int, bytes]], most: int = AUTOMATON_WORDS) -> Iterator[Automaton]:
    """Automata of at most that many words each, or one passage; so that a shard's memory is bounded whatever it holds."""
    held: list[tuple[int, list[bytes]]] = []
    n = 0
    for doc_id, text in passages:
        words = text.split()
        if held and n + len(words) > most:
            yield Automaton(held)
            held, n = [], 0
        held.append((doc_id, words))
        n += len(words)
    if held:
        yield Automaton(held)


def _streamed(docs: pa.Table, passages: pa.Table) -> pa.Table:
    """doc_id, part, n_removed and kept_sha256 for each document of a shard."""
    ids, parts = docs.column("doc_id").to_pylist(), docs.column("part").to_pylist()
    rows = list({(i, p): n for n, (i, p) in enumerate(zip(ids, parts, strict=True))}.items())  # rows that repeat are one document
    texts = docs.column("text")
    ends = [np.zeros(len(words_of(texts[n].as_py())) + 1, dtype=np.int64) for _, n in rows]
    for automaton in automata(list(zip(passages.column("owner").to_pylist(), passages.column("words").to_pylist(), strict=True))):
        for (key, n), marks in zip(rows, ends, strict=True):
            at = automaton.hits(key[0], words_of(texts[n].as_py()))
            np.add.at(marks, at, 1)
            np.add.at(marks, np.asarray(at, dtype=np.int64) + WINDOW, -1)
    out = []
    for (key, n), marks in zip(rows, ends, strict=True):
        left = [w for w, gone in zip(words_of(texts[n].as_py()), np.cumsum(marks[:-1]) > 0, strict=True) if not gone]
        out.append((*key, len(marks) - 1 - len(left), _digest(left)[0]))
    settle()
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "part", "n_removed", "kept_sha256"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})


def confirmed_windows(texts: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Windows by shard, and of those that recur the owner (doc_id, part) and a place there; both kept.

    texts: doc_id, part, text, anchors. The two longs of an owner come from one row, since both least values follow doc_id in the same order."""
    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")
    rows = texts.mapInArrow(_window_rows, WINDOWS).withColumn("shard", shard)
    by_shard = rows.groupBy("anchor", "window", "shard").agg(F.min("doc_id").alias("least"), F.min_by("part", "doc_id").alias("part"), F.min_by("at", "doc_id").alias("at"), F.max("doc_id").alias("most"))
    by_shard = kept(by_shard, "phrase-windows")
    owners = by_shard.groupBy("anchor", "window").agg(F.min("least").alias("owner"), F.min_by("part", "least").alias("owner_part"), F.min_by("at", "least").alias("at"), F.max("most").alias("most"))
    owners = owners.filter("owner < most").select("anchor", "window", "owner", "owner_part", "at", F.expr(f"at div {CELL}").alias("cell"))
    return by_shard, kept(owners, "phrase-owners")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs, without the words of windows that start in a document with a smaller doc_id as well.

    Null, empty and wordless texts have no words, texts of fewer than 50 words no window, and lose nothing; very long ones are looked through whole.
    A row without doc_id has none smaller and is smaller than none: it keeps all words and takes none. Rows that repeat a doc_id are judged each,
    and take nothing from each other; rows that repeat another in all are decided alike. Other columns are not read; an empty table gives an empty result."""
    spark = ready(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = kept(named.mapInArrow(_rows, ROWS), "phrase-rows")
    copies = rows.filter(f"n_words >= {WINDOW} and doc_id is not null").groupBy("words_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("words_sha256", "first")
    rows = rows.join(copies, "words_sha256", "left")

    pairs = kept(rows.filter("doc_id is not null and doc_id <= coalesce(first, doc_id)").select("doc_id", "part", F.explode("anchors").alias("anchor")), "phrase-anchors")
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    marked = kept(pairs.join(shared, "anchor", "left_semi").groupBy("doc_id", "part").agg(F.collect_set("anchor").alias("anchors")), "phrase-marked")

    hashed = marked.select(F.xxhash64("doc_id").alias("hash"))
    bits = member_bits(hashed, "hash", min(24, max(16, (16 * hashed.count()).bit_length())))
    texts = named.filter("doc_id is not null").withColumn("hash", F.xxhash64("doc_id")).mapInArrow(_parted(bits), "doc_id long, text string, part long")
    texts = kept(texts.join(marked, ["doc_id", "part"]), "phrase-texts")
    weight = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-weight // SHARD_BYTES))

    windows, owners = confirmed_windows(texts, shards)
    cells = owners.groupBy(F.col("owner").alias("doc_id"), F.col("owner_part").alias("part"), "cell").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    cells = cells.groupBy("doc_id", "part").agg(F.collect_list(F.struct("cell", "low", "high")).alias("cells"))
    passages = texts.select("doc_id", "part", "text").join(cells, ["doc_id", "part"]).mapInArrow(_cut, "owner long, owner_part long, cell long, words binary").dropDuplicates(["owner", "owner_part", "cell"])
    wanted = windows.select("anchor", "window", "shard", "most").join(owners, ["anchor", "window"]).filter("most > owner").select("shard", "owner", "owner_part", "cell").distinct()
    routed = wanted.join(passages, ["owner", "owner_part", "cell"]).select("shard", "owner", "words")

    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int").alias("shard")
    found = texts.select("doc_id", "part", "text", shard).groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(_streamed, "doc_id long, part long, n_removed long, kept_sha256 string")
    found = kept(found.filter("n_removed > 0"), "phrase-found")

    whole = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    left = F.when(whole, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "words_sha256"))
    return rows.join(found, ["doc_id", "part"], "left").select("doc_id", "n_words", removed.cast("long").alias("n_removed"), left.alias("kept_sha256"))
