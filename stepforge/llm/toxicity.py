"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a learned lexicon (words and word beginnings), lexicon words near a
second-person word, capitals, punctuation and obfuscation. They are taken once per distinct word of a slice
of texts and summed per text. Lexicon, trees and calibration are learned from one bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepforge.llm.common import kept, ready, text_slices
from stepforge.llm.pretokens import units
from stepforge.llm.samples import bounded, remainder

#: Rows of each label that the fit sees at most; entries of the lexicon at most, and the toxic texts an entry must be in.
SAMPLE, LEXICON, SUPPORT = 6_000, 2_000, 4
#: Folds of the sample.
FOLDS = 3
#: Lengths of word beginnings that the lexicon may hold; words between a lexicon word and a second-person word that count as near.
STEMS, NEAR = (4, 5, 6, 7), 4
ROUNDS, DEPTH, RATE, BINS, LEAF = 60, 4, 0.2, 32, 8
#: Units that a task remembers, and UTF-8 bytes of a slice of texts.
REMEMBERED, SLICE = 200_000, 2 << 20
#: The same of texts whose entries are listed one by one.
SMALL = 1 << 18

# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer ti tus tuyo usted ustedes vosotros".split())
# Characters that stand for letters in obfuscated words.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasii")

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIDDLE = re.compile(r"[\W\d_]")


def core(unit: str) -> str:
    """The unit in lower case without what is not a letter or digit at its ends."""
    return _EDGE.sub("", unit).lower()


def plain(unit: str) -> str:
    """The letters of a unit, with characters that stand for letters read as those."""
    return "".join(_WORD.findall(unit.lower().translate(STANDS_FOR)))


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def weights(self, word: str) -> tuple[float, float, float]:
        """Weight of a core as a word, as a beginning, and as an obfuscated word."""
        straight = self.words.get(word, 0.0)
        stem = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), default=0.0)
        hidden = 0.0
        if _MIDDLE.search(word):
            bare = plain(word)
            hidden = max(self.words.get(bare, 0.0), max((self.stems.get(bare[:n], 0.0) for n in STEMS if len(bare) >= n), default=0.0))
        return straight, stem, hidden


#: Sums over a unit: the first six make positions, the rest are added up.
UNIT = ("word", "stem", "hidden", "hit", "you", "shout", "letters", "upper", "digits", "marks", "exclaim", "mixed")
FEATURES = ("word_density", "stem_density", "hidden_density", "hits", "hit_density", "near_you", "you_density", "shout_density", "upper_share", "digit_share", "mark_share", "exclaim_density", "mixed_density", "log_units", "word_sum", "stem_sum", "word_most", "stem_most", "hidden_most")


_kinds: list[np.ndarray] = []


def _char_kinds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point is a letter, in upper case, a digit."""
    if not _kinds:
        chars = [chr(c) for c in range(1 << 16)]
        _kinds.extend([np.array([c.isalpha() for c in chars]), np.array([c.isupper() for c in chars]), np.array([c.isdigit() for c in chars])])
    low = np.minimum(codes, 65535)
    out = tuple(k[low] for k in _kinds)
    for at in np.flatnonzero(codes > 65535).tolist():
        c = chr(codes[at])
        out[0][at], out[1][at], out[2][at] = c.isalpha(), c.isupper(), c.isdigit()
    return out


def unit_rows(lexicon: Lexicon, new: list[str]) -> np.ndarray:
    """A row of UNIT for each unit."""
    codes = np.frombuffer("\n".join([*new, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(u) for u in new], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    letters, upper, digits, exclaim = (np.add.reduceat(k.astype(np.int64), starts) for k in (*_char_kinds(codes), codes == 33))
    out = np.zeros((len(new), len(UNIT)), dtype=np.float32)
    for row, unit in enumerate(new):
        word = core(unit)
        weights = lexicon.weights(word)
        out[row, :3] = weights
        out[row, 3] = max(weights) > 0
        out[row, 4] = word in SECOND_PERSON
        out[row, 11] = letters[row] > 0 and _MIDDLE.search(word) is not None
    out[:, 5] = (letters > 2) & (upper == letters)
    out[:, 6], out[:, 7], out[:, 8], out[:, 9], out[:, 10] = letters, upper, digits, sizes - letters - digits, exclaim
    return out


class Units:
    """Rows of the units met so far; beyond REMEMBERED it starts afresh."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.at, self.rows = lexicon, {}, np.zeros((0, len(UNIT)), np.float32)

    def of(self, distinct: list[str]) -> np.ndarray:
        new = [u for u in distinct if u not in self.at]
        if len(self.at) + len(new) > REMEMBERED:
            self.at, self.rows, new = {}, self.rows[:0], distinct
        if new:
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, unit_rows(self.lexicon, new)])
        return self.rows[[self.at[u] for u in distinct]].astype(np.float64)


def features(known: Units, texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    texts = pa.compute.replace_substring_regex(pa.compute.fill_null(texts, ""), r"[\t\n\v\f\r]", " ")
    offsets, codes, distinct = units(texts)
    each = known.of(distinct)
    filled = np.array([bool(u) for u in distinct], dtype=np.float64)[codes]
    first = offsets[:-1]
    sums = np.stack([np.add.reduceat(each[:, j][codes], first) for j in range(len(UNIT))], axis=1)
    most = [np.maximum.reduceat(each[:, j][codes], first) for j in range(3)]
    owner = np.repeat(np.arange(len(first)), np.diff(offsets))
    hit, you = each[:, 3][codes] > 0, each[:, 4][codes] > 0
    near = np.zeros(len(codes), dtype=bool)
    for d in range(1, NEAR + 1):
        same = owner[d:] == owner[:-d]
        near[d:] |= you[:-d] & same
        near[:-d] |= you[d:] & same
    close = np.add.reduceat((hit & near).astype(np.float64), first)
    n = np.maximum(np.add.reduceat(filled, first), 1)
    chars = np.maximum(sums[:, 6] + sums[:, 8] + sums[:, 9], 1)
    s = dict(zip(UNIT, sums.T, strict=True))
    return np.stack([s["word"] / n, s["stem"] / n, s["hidden"] / n, s["hit"], s["hit"] / n, close, s["you"] / n, s["shout"] / n, s["upper"] / np.maximum(s["letters"], 1), s["digits"] / chars, s["marks"] / chars, s["exclaim"] / n, s["mixed"] / n, np.log1p(n), s["word"], s["stem"], *most], axis=1)


class Trees:
    """Gradient boosting of the logistic loss by histogram trees of fixed depth."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, BINS)[1:-1]), np.quantile(p, np.linspace(0, 1, BINS // 2)[1:-1]) if len(p := c[c > c.min()]) else []])) for c in x.T]
        bins = self._binned(x)
        p = float((y * weight).sum() / weight.sum())
        self.base = math.log(max(p, 1e-6) / max(1 - p, 1e-6))
        raw = np.full(len(y), self.base)
        wide = max(len(e) for e in self.edges) + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h = (y - prob) * weight, np.maximum(prob * (1 - prob), 1e-6) * weight
            nodes = (1 << self.depth) - 1
            axis, cut, node = np.zeros(nodes, np.int64), np.full(nodes, wide), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                start, count = (1 << level) - 1, 1 << level
                best = np.zeros(count)
                for j in range(x.shape[1]):
                    cell = (node - start) * wide + bins[:, j]
                    sg, sh, sn = (np.bincount(cell, weights=w, minlength=count * wide).reshape(count, wide).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sn < LEAF) | (tn - sn < LEAF)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(count), at] > best + 1e-9
                    best[better] = gain[np.arange(count), at][better]
                    axis[start : start + count][better], cut[start : start + count][better] = j, at[better]
                node = 2 * node + 1 + (bins[np.arange(len(y)), axis[node]] > cut[node])
            leaf = node - nodes
            sums = [np.bincount(leaf, weights=w, minlength=nodes + 1) for w in (g, h)]
            value = self.rate * sums[0] / (sums[1] + 1)
            raw = raw + value[leaf]
            self.trees.append((axis, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for axis, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, axis[node]] > cut[node])
            out += value[node - len(axis)]
        return out


def isotonic(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the nondecreasing fit of y by scores (pool adjacent violators), to be interpolated."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, t, w in zip(scores[order], y[order], weight[order], strict=True):
        pools.append([t * w, w, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b = pools.pop(), pools.pop()
            pools.append([b[0] + a[0], b[1] + a[1], b[2], a[3]])
    at = np.array([e for p in pools for e in (p[2], p[3])])
    value = np.array([p[0] / p[1] for p in pools for _ in range(2)])
    return at, value


@dataclass
class Toxicity:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.raw(x), self.at, self.value), 0, 1)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word and word beginning of a text once."""
    for part in text_slices(batches, limit=SMALL):
        found: list[tuple[str, bool, int]] = []
        for text, toxic, fold in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            words = {w for u in (text or "").split() if (w := core(u))}
            found += [(w, False, toxic, fold) for w in words]
            found += [(s, True, toxic, fold) for s in {w[:n] for w in words for n in STEMS if len(w) >= n}]
        columns = zip(*found, strict=True) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.int32()), strict=True)], names=["entry", "stem", "toxic", "fold"])


def entry_counts(sample: DataFrame) -> DataFrame:
    """entry, stem, fold, p, q: toxic and other texts of each fold that have an entry."""
    each = sample.select("text", "toxic", "fold").mapInArrow(_entries, "entry string, stem boolean, toxic int, fold int")
    return each.groupBy("entry", "stem", "fold").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))


def learned_lexicon(counts: DataFrame, totals: dict[tuple[int, int], int], without: int | None = None) -> Lexicon:
    """Entries far likelier in toxic texts than in others, weighted by their smoothed log odds; of all folds (fold, toxic: texts) but one."""
    pos, neg = (sum(n for (fold, toxic), n in totals.items() if toxic == k and fold != without) for k in (1, 0))
    if not pos or not neg:
        return Lexicon()
    counts = counts.filter(F.lit(True) if without is None else F.col("fold") != without).groupBy("entry", "stem").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    odds = F.log(((F.col("p") + 0.5) / (pos + 1)) / ((F.col("q") + 0.5) / (neg + 1)))
    # by evidence as well as by odds: a rare word of a few texts says little
    top = counts.filter(F.col("p") >= SUPPORT).withColumn("w", odds).filter("w > 1.5").orderBy(F.desc(F.col("w") * F.sqrt("p")), "entry", "stem").limit(LEXICON).collect()
    return Lexicon({r.entry: r.w for r in top if not r.stem}, {r.entry: r.w for r in top if r.stem})


def _sample_features(lexicon: Lexicon):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(lexicon)
        for part in text_slices(batches, limit=SLICE):
            x = features(known, part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "toxic", "fold")), pa.array(list(x), type=pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    return take


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0: at most SAMPLE of each label, by hash of the id.

    A lexicon holds its own texts' labels. So a text of the sample has its densities by a lexicon learned without its fold, as a new text
    has them; on these the trees are grown, and each fold's scores by trees of the other folds are what is calibrated. The lexicon of all folds serves new texts."""
    ready(docs.sparkSession)
    learn = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder("doc_id", 5) != 0)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known_rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(known_rows, "doc_id", "left_semi")
    counts = {r.toxic: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = bounded(docs, learn, "toxic", SAMPLE).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    sample = kept(sample, "toxic-sample")
    totals = {(r.fold, r.toxic): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    entries = kept(entry_counts(sample), "toxic-entries")
    lexicon = learned_lexicon(entries, totals)
    # a task holds the units of one lexicon
    parts = [sample.filter(F.col("fold") == f).mapInArrow(_sample_features(learned_lexicon(entries, totals, f)), "doc_id long, toxic int, fold int, x array<double>") for f in range(FOLDS)]
    rows = reduce(DataFrame.union, parts).collect()
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len({r.toxic for r in rows}) < 2:
        return Toxicity(lexicon, None, np.zeros(1), np.zeros(1), prior)
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x, y, fold = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], dtype=np.float64), np.array([r.fold for r in rows])
    seen = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([counts[0] / seen[0], counts[1] / seen[1]])[y.astype(int)]  # the sample has both labels alike, the corpus has not
    weight = weight / weight.mean()
    out = np.zeros(len(y))
    for f in np.unique(fold):
        rest = fold != f
        if len(np.unique(y[rest])) < 2:
            return Toxicity(lexicon, None, np.zeros(1), np.zeros(1), prior)
        out[~rest] = Trees().fit(x[rest], y[rest], weight[rest]).raw(x[~rest])
    return Toxicity(lexicon, Trees().fit(x, y, weight), *isotonic(out, y, weight), prior)


def _scored(model: Toxicity):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(model.lexicon)
        for part in text_slices(batches, limit=SLICE):
            s = model.scores(features(known, part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return score


def scored(docs: DataFrame, labels: DataFrame, model: Toxicity | None = None) -> DataFrame:
    """row (a struct of all columns of docs), score, predicted for every row; score is the calibrated probability of labels.toxic = 1.

    Null and empty texts are scored as texts without words. Repeated rows are scored each; of labels that
    repeat a doc_id the largest counts; a null doc_id is not learned from. Without both labels to learn
    from, every score is the share of toxic labels. Other columns are carried in row, whatever their
    names; an empty table gives an empty result.
    """
    model = model or fit(docs, labels)
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(_scored(model), schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted."""
    rows = scored(docs.select(F.col("doc_id").cast("long"), "text"), labels)
    return rows.select("row.doc_id", "score", "predicted").withColumn("held_out", remainder("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")
