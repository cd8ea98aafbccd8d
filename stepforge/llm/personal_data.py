"""Personal data: pattern spans, and terms that give protected entities away.

Patterns find emails, addresses, cards and phone numbers in whole texts. Every distinct value found is a
protected entity. The terms of the documents that mention it are counted over the corpus: how many documents
have both the term and the entity, and how many have the term at all. A term that at least SUPPORT documents have
beside one entity, and whose presence makes that entity likely (the disclosure P(entity | term)) and far likelier than it
is by itself (the gain in bits; for frequent entities a part of the gain they can reach), is sensitive wherever it stands: it is generalised, or removed where it
all but names the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stepforge.llm.common import among, kept, likely, member_bits, ready, text_slices
from stepforge.llm.words import joined, runs, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Documents that must have both a term and one entity.
SUPPORT = 3
#: Disclosure from which a term is generalised, and from which it is removed; the least gain in bits.
DISCLOSURE, REMOVED, BITS = 0.5, 0.9, 6.0
#: The gain is at most -log2 P(entity), which frequent entities have less of than BITS: there this part of it is enough, if all
#: documents with the term together give so many bits of evidence (their number by the divergence of P(entity | term) from P(entity)).
GAIN_PART, EVIDENCE = 0.75, SUPPORT * BITS
#: Bits (as a power of two) of the filter that keeps most terms of no interest from being shuffled; it loses none of the others.
FILTER_BITS = 23
#: Terms that a task holds counts of before it hands them on; sensitive terms (of about 30 bytes) that are broadcast at most.
HELD_TERMS, BROADCAST_TERMS = 1_000_000, 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost local parts reach back from an @ to the start of their run, or to the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", m.end())
        else:
            done = at + 1  # nothing that starts before this @ can match
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their check are dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((3, *m.span()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _entity(text: str, span: tuple[int, int, int]) -> int:
    """A hash of the value, emails in lower case, numbers by their digits; its last two bits are the kind."""
    kind, a, b = span
    value = text[a:b].lower() if kind == 0 else text[a:b] if kind == 1 else "".join(_DIGITS.findall(text[a:b]))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True) & ~3 | kind


def terms_beside(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Distinct terms of the text, other than those that stand inside mentions alone."""
    data, _ = joined([text])
    starts, ends = runs(data, terms=True)
    hashes = word_hashes(data, starts, ends).view(np.int64)
    places = np.array([m.span() for m in _TERM.finditer(text)], dtype=np.int64).reshape(-1, 2)
    inside = np.zeros(len(places), dtype=bool)
    for _, a, b in spans:
        inside[np.searchsorted(places[:, 1], a, side="right") : np.searchsorted(places[:, 0], b)] = True
    return np.unique(hashes[~inside])


_SPAN = "array<struct<kind:int,start:int,stop:int>>"
_FOUND = f"doc_id long, row_key long, spans {_SPAN}, entities array<long>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    for part in text_slices(batches):
        spans, entities = [], []
        for text in part.column("text").to_pylist():
            text = text or ""
            own = base_spans(text)
            spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in own])
            entities.append(sorted({_entity(text, s) for s in own}))
        columns = [part.column("doc_id"), part.column("row_key"), pa.array(spans, span_type), pa.array(entities, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "spans", "entities"])


def _paired(bits: np.ndarray):
    """term, entity, n: documents that have both, of entities that pass the filter; without entity, those that have the term and any of these."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def settled() -> None:
            nonlocal keys, n, held, size
            rows = np.concatenate([keys, *held])
            counts = np.concatenate([n, np.ones(len(rows) - len(keys), np.int64)])
            order = np.lexsort(rows.T)
            rows, counts = rows[order], counts[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
            keys, n = rows[new], np.add.reduceat(counts, new) if len(new) else counts
            held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1], mask=keys[:, 2] == 0), pa.array(n)], names=["term", "entity", "n"])

        for part in text_slices(batches):
            for text in part.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                entities = np.array(sorted({_entity(text, s) for s in own}), dtype=np.int64)
                # the bits are of the entities' hashes as they are
                entities = entities[among(bits, entities)] if len(entities) else entities
                if not len(entities):
                    continue
                terms = terms_beside(text, own)
                held.append(np.column_stack([terms, np.zeros((len(terms), 2), np.int64)]))
                size += len(terms)
                for e in entities:
                    held.append(np.column_stack([terms, np.full(len(terms), e), np.ones(len(terms), np.int64)]))
                    size += len(terms)
                    if size > HELD_TERMS // 2:
                        settled()
                        if len(keys) > HELD_TERMS // 2:
                            yield out()
                            keys, n = keys[:0], n[:0]
        settled()
        yield out()

    return pair


_HIT = "doc_id long, row_key long, term long, start int, stop int"


def _present(part: pa.RecordBatch, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Terms of a slice that pass the filter: document's place, hash, start and end byte, with the slice's bytes and bounds."""
    data, bounds = joined(part.column("text").to_pylist())
    starts, ends = runs(data, terms=True)
    hashes = word_hashes(data, starts, ends)
    take = np.flatnonzero(among(bits, hashes))
    owner = np.searchsorted(bounds, starts[take], side="right") - 1
    return owner, hashes[take], starts[take], ends[take], data, bounds


def _counted(bits: np.ndarray):
    """term, n: documents that have it, summed up over the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        for part in text_slices(batches):
            owner, hashes, *_ = _present(part, bits)
            order = np.lexsort((owner, hashes))
            owner, hashes = owner[order], hashes[order]
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            own, counts = np.unique(hashes[new], return_counts=True)
            terms, at = np.unique(np.concatenate([terms, own]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, counts]), minlength=len(terms)).astype(np.int64)
            if len(terms) > HELD_TERMS:
                yield out()
                terms, n = terms[:0], n[:0]
        yield out()

    return count


def _hits(bits: np.ndarray):
    """Occurrences of terms whose bit is set in the filter, by code points."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            owner, hashes, starts, ends, data, bounds = _present(part, bits)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
            base = points[bounds[owner]]
            doc, key = (part.column(c).take(pa.array(owner)) for c in ("doc_id", "row_key"))
            columns = [doc, key, pa.array(hashes.view(np.int64)), pa.array((points[starts] - base).astype(np.int32)), pa.array((points[ends] - base).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "term", "start", "stop"])

    return find


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def near_counts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """term, entity, n_near for terms that SUPPORT documents have beside one entity, and that could reach the disclosure.

    Only entities of as many documents come into question. A term is in at least as many documents as have it
    beside any of these; where even these are too many, the corpus need not be asked."""
    of = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    often = kept(of.filter(F.col("n") >= SUPPORT).select("entity"), "private-often")
    bits = member_bits(often, "entity", FILTER_BITS)
    pairs = rows.select("text").mapInArrow(_paired(bits), "term long, entity long, n long").groupBy("term", "entity").agg(F.sum("n").alias("n"))
    pairs = kept(pairs.filter(F.col("n") >= SUPPORT), "private-pairs")
    near = pairs.filter("entity is not null").join(often, "entity", "left_semi").withColumnRenamed("n", "n_near")
    any_ = pairs.filter("entity is null").select("term", F.col("n").alias("n_any"))
    return near.join(any_, "term").filter(F.col("n_near") >= DISCLOSURE * F.col("n_any")).select("term", "entity", "n_near")


def sensitive_terms(found: DataFrame, in_docs: DataFrame, near: DataFrame) -> DataFrame:
    """term, disclosure, removed, kind (of the entity that it discloses most) for the terms over the thresholds; near holds (term, entity, n_near), in_docs (term, n)."""
    total = found.count()
    in_docs = in_docs.groupBy("term").agg(F.sum("n").alias("n_term"))
    of = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    share = F.col("n_near") / F.col("n_term")
    alone = F.col("n_entity") / F.lit(float(max(total, 1)))
    bits = F.log2(share / alone)
    rest = F.when((share < 1) & (alone < 1), (1 - share) * F.log2((1 - share) / (1 - alone))).otherwise(0.0)
    frequent = (alone < 1) & (bits >= -GAIN_PART * F.log2(alone)) & (F.col("n_term") * (share * bits + rest) >= EVIDENCE)
    over = near.join(in_docs, "term").join(of, "entity").filter((share >= DISCLOSURE) & ((bits >= BITS) | frequent))
    most = over.groupBy("term").agg(F.max(F.struct(share.alias("disclosure"), F.col("entity").alias("entity"))).alias("most"))
    disclosure = F.col("most.disclosure")
    return most.select("term", disclosure.alias("disclosure"), (disclosure >= REMOVED).alias("removed"), F.col("most.entity").bitwiseAND(F.lit(3)).cast("int").alias("kind"))


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, spans (the patterns'), terms (of the method, those beside the patterns' spans) for every row of docs.

    A null text counts as empty. Repeated rows are documents each in the counts, and have the same spans;
    a null doc_id stays null; columns other than doc_id and text are not read; an empty table gives an
    empty result.
    """
    ready(docs.sparkSession)
    rows = _keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = kept(rows.mapInArrow(_found, _FOUND), "private-found")
    near = kept(near_counts(rows, found), "private-near")
    term_type = "array<struct<start:int,stop:int,removed:boolean,kind:int>>"
    base = found.select("doc_id", "row_key", "spans")
    bare = base.withColumn("terms", F.array().cast(term_type))
    if near.isEmpty():
        return bare
    bits = member_bits(near.select("term").distinct(), "term", FILTER_BITS)
    in_docs = kept(docs.select(F.col("text").cast("string")).mapInArrow(_counted(bits), "term long, n long"), "private-counts")
    sensitive = kept(sensitive_terms(found, in_docs, near), "private-terms")
    if sensitive.isEmpty():
        return bare
    hits = rows.mapInArrow(_hits(member_bits(sensitive, "term", FILTER_BITS)), _HIT)
    # a frequent term is one hot key of a shuffle; a longer list of terms is joined by one all the same, where skewed partitions are split
    terms = F.broadcast(sensitive) if sensitive.count() <= BROADCAST_TERMS else sensitive
    own = hits.join(terms, "term").groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "removed", "kind"))).alias("terms"))
    own = own.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "terms")
    both = base.join(own, (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    beside = F.filter(F.coalesce("terms", F.array().cast(term_type)), lambda t: ~F.exists("spans", lambda s: (t["start"] < s["stop"]) & (s["start"] < t["stop"])))
    return both.select("doc_id", "row_key", "spans", beside.alias("terms"))


def private_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: counts of the patterns' spans and all spans written out."""
    rows = private_spans(docs)
    write = lambda c, name: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = write(F.col("spans"), lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1))
    terms = write(F.col("terms"), lambda s: F.lit("term"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    joined_up = F.concat_ws(",", F.when(F.size("spans") > 0, base), F.when(F.size("terms") > 0, terms))
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_up.alias("spans"))


def rewritten(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans (start, end, replacement) replaced; of overlapping ones the first stands for all."""
    out, at = [], 0
    for a, b, new in sorted(spans):
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join([*out, text[at:]])


def generalised(term: str, kind: int) -> str:
    """What stands for a sensitive term: its shape (number, name, code of letters and digits, or word) and the kind of entity that it leads to."""
    if term.isdigit():
        shape = "NUMBER"
    elif any(c.isdigit() for c in term):
        shape = "CODE"
    else:
        shape = "NAME" if term[:1].isupper() else "WORD"
    return f"[{shape} NEAR {KINDS[kind].upper()}]"


def sanitised(docs: DataFrame) -> DataFrame:
    """All columns of docs, personal data in text replaced by [KIND], sensitive terms by their class (see generalised), or by nothing where they all but name the entity.

    Null texts stay null; rows that repeat are rewritten alike; of overlapping spans, ties included, the first and then the shorter one stands for all; an empty table gives an
    empty one. All columns travel as one struct, so none of them can clash with a name used here."""
    marks = [f"[{k.upper()}]" for k in KINDS]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = b.column("row"), []
            for text, spans, terms in zip(rows.field("text").to_pylist(), *(b.column(c).to_pylist() for c in ("spans", "terms")), strict=True):
                own = [(s["start"], s["stop"], marks[s["kind"]]) for s in spans or []]
                own += [(t["start"], t["stop"], "" if t["removed"] else generalised(text[t["start"] : t["stop"]], t["kind"])) for t in terms or []]
                texts.append(text if text is None or not own else rewritten(text, own))
            yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string())], names=["row", "new"])

    spans = private_spans(docs).filter("size(spans) > 0 or size(terms) > 0").dropDuplicates(["row_key", "doc_id"])
    spans = kept(spans.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "spans", "terms"), "private-spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("own"))
    has = likely(spans.select("key"), "key")
    both = rows.filter(has("own")).join(spans, (F.col("own") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id")), "left")
    # written, so that no task holds two Python workers, the filter's and the rewriting one
    both = kept(both.select("row", "spans", "terms"), "private-texts")
    new = both.mapInArrow(rewrite, StructType([rows.schema["row"], StructField("new", StringType())])).select(F.col("row").withField("text", F.col("new")).alias("row"))
    return rows.filter(~has("own")).select("row").unionByName(new).select("row.*")
