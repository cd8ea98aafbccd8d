"""Pre-tokens of the two byte-level tokenizers, each encoded once per distinct pre-token.

Texts are cut at spaces into units; a unit is cut into pre-tokens once, a pre-token is encoded once, and what
is known of both is kept in flat arrays, so that a slice of texts is put together by gathering rows.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from stepforge.llm.common import remembered

#: Distinct units that a Python worker remembers, with their pre-tokens.
REMEMBERED = 700_000
#: UTF-8 bytes of a slice of texts: the more, the more often a unit is met within it.
SLICE = 4 << 20
#: Pre-tokens that go to the library in one call: an encoding of the library is far larger than its ids.
ENCODED = 4096
#: Stands between strings that are split together; strings that hold it are split one by one.
_BETWEEN = "\U0010ffff"

# The splitting patterns of the tokenizers' own files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _among_others(pattern: str) -> str:
    """The pattern for many strings in one, _BETWEEN standing where one ends."""
    return _BETWEEN + "|" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{_BETWEEN}]").replace(r"(?!\S)", rf"(?![^\s{_BETWEEN}])")


class Memory:
    """Values of keys, the lately used ones kept: what forgets the older half costs time and nothing else."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def values(self, keys: list[str], compute: Callable[[list[str]], Iterable]) -> list:
        """The value of each of the distinct keys; compute gives those that are not remembered."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                value = old.get(k)
                if value is None:
                    new.append(k)
                else:
                    young[k] = value
        if new:
            young.update(zip(new, compute(new), strict=True))
        return [young[k] for k in keys]


class Pretokens:
    """The pre-tokens of strings, and the ids of pre-tokens, by a tokenizers file."""

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marked = {f"\0\0{name}": i for name, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        spec |= {"added_tokens": [], "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.words = words
        self.pattern = regex.compile(WORD_PATTERN if words else BYTE_PATTERN)
        self.joined = regex.compile(_among_others(self.pattern.pattern))

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string stays whole, marked by a leading NUL pair."""
        if self.cut is not None and self.cut.search(text):
            parts = self.cut.split(text)
            return [x for i, p in enumerate(parts) for x in ([f"\0\0{p}"] if i % 2 else self.pattern.findall(self._normal(p)))]
        return self.pattern.findall(self._normal(text))

    def _normal(self, text: str) -> str:
        if not self.words:
            return text
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def split_all(self, strings: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all strings in turn, and how many each string has."""
        text = _BETWEEN.join(strings)
        if text.count(_BETWEEN) != max(0, len(strings) - 1) or (self.cut is not None and self.cut.search(text)):
            lists = [self.split(s) for s in strings]
            return [p for x in lists for p in x], np.array([len(x) for x in lists], dtype=np.int64)
        coded = self.joined.findall(self._normal(text))
        ends = np.flatnonzero(np.array([p == _BETWEEN for p in coded], dtype=bool))
        sizes = np.diff(np.concatenate([[-1], ends, [len(coded)]])) - 1
        return [p for p in coded if p != _BETWEEN], sizes if strings else sizes[:0]

    def _library(self, new: list[str]) -> Iterable:
        """The library's encoding of each pre-token, or the id of a marked special string."""
        for k in range(0, len(new), ENCODED):
            part = new[k : k + ENCODED]
            own = self.bare.encode_batch_fast(part, add_special_tokens=False)
            for mark, i in self.marked.items():
                if mark in part:
                    own[part.index(mark)] = i
            yield own

    def counts(self, new: list[str]) -> np.ndarray:
        """How many pieces each of the distinct pre-tokens has; ids are not taken out of the library."""
        return np.array([1 if isinstance(e, int) else len(e) for own in self._library(new) for e in own], dtype=np.int64)

    def ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all of the distinct pre-tokens in turn, and how many each has."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for own in self._library(new):
            own = [[e] if isinstance(e, int) else e.ids for e in own]
            sizes.append(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
            flat.append(np.fromiter(chain.from_iterable(own), dtype="<u4", count=int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)


class Codes(dict):
    """Numbers strings from 0 in the order in which they are first met."""

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code

    def of(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """The code of each string, and the strings that are new, in the order of their codes."""
        before = len(self)
        codes = np.fromiter(map(self.__getitem__, strings), dtype=np.int64, count=len(strings))
        return codes, list(islice(self, before, None))


class Rows:
    """Rows of numbers, of any length each, in one flat array that grows."""

    def __init__(self, dtype: str):
        self.flat, self.ends, self.used, self.n = np.zeros(1024, dtype), np.zeros(1024, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        total = self.used + len(flat)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(total, self.flat.dtype)])
        if self.n + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n], np.zeros(self.n + len(sizes), np.int64)])
        self.flat[self.used : total] = flat
        self.ends[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = total, self.n + len(sizes)

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given rows in turn, and how many each has."""
        ends = self.ends[rows]
        starts = np.where(rows > 0, self.ends[rows - 1], 0) if len(rows) else ends
        sizes = ends - starts
        return self.flat[spread(starts, sizes)], sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """What a Python worker knows of units and pre-tokens: the codes of each unit's pre-tokens, and for each
    pre-token its ids, or with counts alone how many it has. Beyond `most` units those met once are forgotten,
    which costs time and nothing else."""

    def __init__(self, path: str, words: bool, counts: bool, most: int = REMEMBERED):
        self.pre, self.only_counts, self.most = Pretokens(path, words), counts, most
        self.units, self.pretokens = Codes(), Codes()
        self.codes, self.values = Rows("<i4"), Rows("<u4")
        self.met = np.zeros(0, np.int64)

    def pretoken_codes(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the pre-tokens of all strings in turn, and how many each string has."""
        flat, sizes = self.pre.split_all(strings)
        codes, new = self.pretokens.of(flat)
        if self.only_counts:
            self.values.add(self.pre.counts(new), np.ones(len(new), np.int64))
        else:
            self.values.add(*self.pre.ids(new))
        return codes, sizes

    def rows(self, distinct: list[str]) -> np.ndarray:
        """The row of each of the distinct units in codes, until rows are asked for again."""
        if len(self.units) > self.most or len(self.pretokens) > 2 * self.most:
            self._forget()
        out, new = self.units.of(distinct)
        for k in range(0, len(new), 1 << 15):
            self.codes.add(*self.pretoken_codes(new[k : k + (1 << 15)]))
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[out] += 1
        return out

    def _forget(self) -> None:
        """Keeps units met more than once, those met most if they are more than half."""
        least = 2
        while (kept := np.flatnonzero(self.met >= least)).size > self.most // 2:
            least *= 2
        codes, sizes = self.codes.taken(kept)
        used, codes = np.unique(codes, return_inverse=True)
        values, lengths = self.values.taken(used)
        units, pretokens = list(self.units), list(self.pretokens)
        self.units = Codes((units[i], k) for k, i in enumerate(kept.tolist()))
        self.pretokens = Codes((pretokens[i], k) for k, i in enumerate(used.tolist()))
        self.codes, self.values, self.met = Rows("<i4"), Rows("<u4"), np.ones(len(kept), np.int64)
        self.codes.add(codes, sizes)
        self.values.add(values, lengths)


def loaded(path: str, words: bool, counts: bool = False, most: int = REMEMBERED) -> Vocabulary:
    """One per Python worker, until it has a task that does not ask for it."""
    key = (path, words, counts, most)
    return remembered(key, lambda: Vocabulary(*key))


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at every space: where each text's units begin (one entry more), codes of the units, distinct units."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), pattern=" ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
