"""Language identification by nearest centroids of normalised TF-IDF vectors of character n-grams.

Each language has several centroids, found by clustering the vectors of a bounded sample of its rows; a text
takes the language of the centroid nearest by cosine, and is rejected if even that one is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.llm.common import mixed, ready, seeded, text_slices
from stepforge.llm.samples import bounded, remainder

#: Rows of a language that the fit sees at most, centroids of each, hashed dimensions (a power of two), n-gram lengths.
SAMPLE, CENTROIDS, DIM_BITS, GRAMS = 500, 3, 16, (2, 3)
#: A text is rejected if its cosine is below this part of the cosine that FIT_SHARE of the sample's rows exceed, each against
#: centroids of the other half of the sample. Of texts with fewer n-grams than FULL the cosine is small by itself: it counts
#: as divided by the root of their share.
REJECT_PART, FIT_SHARE, FULL = 0.45, 0.99, 400
#: UTF-8 bytes of text at a time: every n-gram of a slice takes some dozens of bytes.
SLICE_BYTES = 1 << 18
#: The language of texts without a letter.
UNDETERMINED = "und"

_DIM = 1 << DIM_BITS
_ODD = seeded(8, 31) | np.uint64(1)
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    flags = _letters[0][np.minimum(codes, 65535)]
    high = np.flatnonzero(codes > 65535)
    flags[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return flags


@dataclass
class Counts:
    """Counts n of hashed n-grams, those above 0 alone: the text of each, in order, and its cell."""

    texts: int
    owner: np.ndarray
    cell: np.ndarray
    n: np.ndarray

    def scale(self) -> np.ndarray:
        """For each text the root of the share of FULL n-grams that it has, 1 at most."""
        return np.sqrt(np.minimum(np.bincount(self.owner, weights=self.n, minlength=self.texts) / FULL, 1))


def gram_counts(texts: list[str | None]) -> tuple[Counts, np.ndarray]:
    """Counts of hashed n-grams, and whether each text has a letter. Runs of other characters count as one space."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
    letter = _is_letter(codes)
    keep = letter | np.concatenate([[False], letter[:-1]])  # of what is between letters, the first character
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    cells = []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            key += codes[k : k + m] * _ODD[k]
        bucket = (mixed(key) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
        fits = owner[:m] == owner[n - 1 :]
        cells.append((owner[:m] * _DIM + bucket)[fits])
    at, n = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
    return Counts(len(lower), at >> DIM_BITS, at & (_DIM - 1), n), np.bincount(owner[letter], minlength=len(lower)) > 0


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centers: np.ndarray  # a row per centroid
    owner: np.ndarray  # the language of each centroid
    floors: np.ndarray  # the least accepted cosine of each language, for texts of FULL n-grams

    def weights(self, counts: Counts) -> np.ndarray:
        """Of each count, its component of the text's vector of length 1."""
        w = np.log1p(counts.n) * self.idf[counts.cell]
        norm = np.sqrt(np.bincount(counts.owner, weights=w**2, minlength=counts.texts))
        return (w / np.maximum(norm, 1e-12)[counts.owner]).astype(np.float32)

    def nearest(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of each text."""
        w = self.weights(counts)
        near = np.stack([np.bincount(counts.owner, weights=w * c[counts.cell], minlength=counts.texts) for c in self.centers], axis=1)
        best = near.argmax(axis=1)
        return self.owner[best], np.clip(near[np.arange(len(near)), best], 0, 1)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest points, the first being the row nearest to the mean."""
    centers = v[[int((v @ v.mean(axis=0)).argmax())]]
    while len(centers) < min(k, len(v)):
        centers = np.vstack([centers, v[int((v @ centers.T).max(axis=1).argmin())]])
    for _ in range(rounds):
        at = (v @ centers.T).argmax(axis=1)
        sums = np.stack([v[at == i].sum(axis=0) if (at == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-12)
    return centers


def fitted(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Centroids | None:
    """From (language, cells, counts) of the sample; None without rows."""
    if not rows:
        return None
    languages = sorted({lang for lang, *_ in rows})
    present = np.zeros(_DIM)
    for _, cells, _ in rows:
        present[cells] += 1
    idf = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + 1
    model = Centroids(languages, idf, np.zeros((0, _DIM), np.float32), np.zeros(0, np.int64), np.zeros(len(languages)))
    for i, lang in enumerate(languages):
        own = [(cells, n) for name, cells, n in rows if name == lang]
        counts = Counts(len(own), np.repeat(np.arange(len(own)), [len(c) for c, _ in own]), np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own]))
        v = np.zeros((len(own), _DIM), np.float32)  # of one language at a time
        v[counts.owner, counts.cell] = model.weights(counts)
        centers = _clusters(v, CENTROIDS).astype(np.float32)
        model.centers = np.vstack([model.centers, centers])
        model.owner = np.append(model.owner, np.full(len(centers), i))
        near = np.zeros(len(own))
        for half in (0, 1):
            if len(own) > 1:
                near[half::2] = (v[half::2] @ _clusters(v[1 - half :: 2], CENTROIDS).T).max(axis=1)
        model.floors[i] = REJECT_PART * float(np.quantile(near / np.maximum(counts.scale(), 1e-12), 1 - FIT_SHARE))
    return model


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, limit=SLICE_BYTES, rows=128):
        counts, has = gram_counts(part.column("text").to_pylist())
        ends = np.searchsorted(counts.owner, np.arange(counts.texts + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (counts.cell, counts.n)]
        yield pa.RecordBatch.from_arrays([part.column("lang"), *lists], names=["lang", "at", "n"]).filter(pa.array(has))


def fit(docs: DataFrame) -> Centroids | None:
    """Learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2: at most SAMPLE of each language, by hash of the id."""
    ready(docs.sparkSession)
    learn = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2)).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"))
    sample = bounded(docs, learn, "lang", SAMPLE).select("lang", "text")
    rows = []
    for r in sample.mapInArrow(_sample_counts, "lang string, at array<int>, n array<int>").orderBy("lang", F.xxhash64("at", "n")).toLocalIterator():
        rows.append((r.lang, np.array(r.at, dtype=np.int32), np.array(r.n, dtype=np.int32)))
    return fitted(rows)


def _predicted(model: Centroids | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SLICE_BYTES, rows=128):
            counts, has = gram_counts(part.column("text").to_pylist())
            if model is None:
                lang, score, rejected = [UNDETERMINED] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
            else:
                at, score = model.nearest(counts)
                lang = [model.languages[i] if h else UNDETERMINED for i, h in zip(at, has, strict=True)]
                score = np.where(has, score, 0.0)
                rejected = ~has | (score < model.floors[at] * counts.scale())
            columns = [part.column("row"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "rejected"])

    return predict


def identified(docs: DataFrame, model: Centroids | None = None) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred, score, rejected for every row of docs.

    lang_pred is a learned language, `und` where the text is null or has no letter (score 0, rejected) and
    everywhere if no row can be learned from; score is the cosine of the nearest centroid; rejected marks
    texts that are farther than any text of that language should be. Ties go to the language first by
    name. Repeated rows are predicted each, a null doc_id is not held out; other columns are carried in
    row, whatever their names; an empty table gives an empty result.
    """
    model = model or fit(docs)
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(_predicted(model), schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score, rejected."""
    rows = identified(docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("lang")))
    return rows.select("row.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", remainder("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")
