"""SentencePiece encoding and decoding by suffix-array matching.

The distinct space-delimited units of a batch are concatenated and indexed by a suffix array; every piece is
binary-searched for its range of occurrences; the occurrences become edges, sorted by the position where they
end; and edges are relaxed in that order. The model's type decides the relaxation. For the byte-pair type of
the public model it keeps, for every prefix, the one last piece of that prefix's encoding: an edge extends an
encoded prefix if the two pieces stand side by side unmerged when they are encoded together. Very long units are indexed
a window at a time, and the prefixes' pieces carried over. (A sum of
scores, as for unigram models, would give other pieces.) Characters without a piece become byte pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import mixed, ready, text_slices
from stepforge.llm.pretokens import Memory, units

SPACE = "▁"
#: Encoded units and pairs of pieces that a Python worker remembers.
REMEMBERED, REMEMBERED_PAIRS = 600_000, 500_000
#: UTF-8 bytes of a slice of texts, and characters that one suffix array indexes.
SLICE, INDEXED = 4 << 20, 400_000
#: Characters of strings that are relaxed together, and slots (as a power of two) for pairs met lately.
SHORT, SLOT_BITS = 64, 20
#: Longer strings count this many times in an index, since each of their positions may end as many pieces as it has characters to reach back to; and characters of a window of a very long one.
DENSE, WINDOW = 8, 16_384
_RUN = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceModel:
    """Pieces of a SentencePiece byte-pair model and what is known of their neighbourhoods."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {names[i]: (-sp.get_score(i), i) for i in normal}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        self.names = names
        self.width = max(len(names[i]) for i in normal)
        # pieces that the encoding of their own text does not give can never appear
        usable = sorted(i for i in normal if self.merged(names[i]) == [names[i]])
        letters = sorted({c for i in normal for c in names[i]})
        self.code = {c: 256 * (k // 255 + 2) + k % 255 + 1 for k, c in enumerate(letters)}
        self.piece_ids = np.array(usable)
        self.piece_len = np.array([len(names[i]) for i in usable])
        keys = np.zeros((len(usable), self.width), dtype=">u2")
        for row, i in enumerate(usable):
            keys[row, : len(names[i])] = [self.code[c] for c in names[i]]
        last = keys.copy()
        last[keys == 0] = 0xFFFF
        as_bytes = f"S{2 * self.width}"
        self.first_key, self.last_key = keys.view(as_bytes).ravel(), last.view(as_bytes).ravel()
        self.known = Memory(REMEMBERED)
        self.pairs: dict[int, bool] = {}
        self.slot_keys, self.slot_fits = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, dtype=bool)
        self.lengths = np.array([len(x) for x in names])

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges done one by one: best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[p][0], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _apart(self, a: int, b: int) -> bool:
        left, right = self.names[a], self.names[b]
        return self.merged(left + right) == [left, right]

    def _ids(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.rank[p][1]] if p in self.rank else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")])]

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, starts and ids of all occurrences of pieces in text, by end and then start."""
        codes = np.full(len(text) + self.width + 3, 257, dtype=">u2")
        codes[: len(text)] = [self.code.get(c, 257) for c in text]
        wide = codes.astype(np.uint64)
        n = len(text)
        four = (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (wide[2:-1] << np.uint64(16)) | wide[3:]
        suffixes = np.lexsort([four[k : k + n] for k in range(0, self.width, 4)][::-1])
        ordered = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, self.width)[suffixes]).view(self.first_key.dtype).ravel()
        lo, hi = np.searchsorted(ordered, self.first_key, "left"), np.searchsorted(ordered, self.last_key, "right")
        found = hi - lo
        which = np.repeat(np.arange(len(lo)), found)
        within = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        starts = suffixes[lo[which] + within]
        ends = starts + self.piece_len[which]
        order = np.lexsort((starts, ends))
        return ends[order], starts[order], self.piece_ids[which][order]

    def encode_units(self, strings: list[str]) -> list[bytes]:
        """Ids of strings that no piece crosses the border of."""
        out, at = [b""] * len(strings), 0
        plain = []
        for k, s in enumerate(strings):
            if len(s) > WINDOW:
                out[k] = self._windowed(s)
            elif s:
                plain.append(k)
        while at < len(plain):
            stop, size = at, 0
            while stop < len(plain):
                n = len(strings[plain[stop]])
                n *= DENSE if n > SHORT else 1
                if stop > at and size + n >= INDEXED:
                    break
                size += n + 1
                stop += 1
            for k, ids in zip(plain[at:stop], self._relaxed([strings[k] for k in plain[at:stop]]), strict=True):
                out[k] = ids
            at = stop
        return out

    def _windowed(self, string: str) -> bytes:
        """A string of any length, indexed by a window at a time; each sees what edges that end in it may start from, and the last pieces found so far."""
        last = np.full(len(string) + 1, -3, dtype=np.int32)
        last[0] = -1
        for at in range(0, len(string), WINDOW):
            low, stop = max(0, at - self.width + 1), min(len(string), at + WINDOW)
            part = string[low:stop]
            own = last[low : stop + 1]
            own[at - low + 1 :][np.array([c not in self.rank for c in string[at:stop]], dtype=bool)] = -2
            ends, starts, ids = self.edges(part)
            new = ends > at - low
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            self._relaxed_one_by_one(own, ends[new], starts[new], ids[new])
        return self._backwards(string, last, 0, len(string))

    def _backwards(self, text: str, last: np.ndarray, begin: int, end: int) -> bytes:
        own = array("I")
        while end > begin:
            i = int(last[end])
            if i < 0:
                own.extend([self.bytes[x] for x in reversed(text[end - 1].encode("utf-8", "surrogatepass"))])
                end -= 1
            else:
                own.append(i)
                end -= len(self.names[i])
        return np.frombuffer(own, dtype=np.uint32)[::-1].astype("<u4").tobytes() if own else b""

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """Whether the two pieces of each key stand side by side unmerged. Slots hold the pairs met lately."""
        slot = (mixed(keys.view(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        fits = self.slot_fits[slot]
        miss = np.flatnonzero(self.slot_keys[slot] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            found = np.zeros(len(new), dtype=bool)
            for n, key in enumerate(new.tolist()):
                known = self.pairs.get(key)
                if known is None:
                    known = self.pairs[key] = self._apart(key >> 20, key & 0xFFFFF)
                found[n] = known
            fits[miss] = found[back]
            self.slot_keys[slot[miss]], self.slot_fits[slot[miss]] = keys[miss], fits[miss]
        return fits

    def _relaxed(self, strings: list[str]) -> list[bytes]:
        text = "\0".join(strings)
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        ends, starts, ids = self.edges(text)
        # the last piece of each prefix: -1 where a string begins, -2 behind a character without a piece, -3 where nothing is known yet
        last = np.full(len(text) + 1, -3)
        last[1:][np.array([c not in self.rank for c in text], dtype=bool)] = -2
        last[begins] = -1
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        of = np.searchsorted(begins, ends - 1, side="right") - 1
        depth = ends - begins[of]
        short = sizes <= SHORT
        # of short strings, prefixes of one length are relaxed together
        order = np.flatnonzero(short[of])
        order = order[np.argsort(depth[order], kind="stable")]
        steps = np.searchsorted(depth[order], np.arange(1, int(sizes[short].max(initial=0)) + 2))
        for low, high in zip(steps[:-1], steps[1:], strict=True):
            own = order[low:high]
            end, i, before = ends[own], ids[own], last[starts[own]]
            can = before != -3
            behind = np.flatnonzero(before >= 0)
            can[behind] = self._fits(before[behind] << 20 | i[behind])
            end, i = end[can], i[can]
            first = np.flatnonzero(np.diff(end, prepend=-1))
            last[end[first]] = i[first]
        self._relaxed_one_by_one(last, *(x[~short[of]] for x in (ends, starts, ids)))
        return self._read_back(text, strings, begins, sizes, short, last)

    def _relaxed_one_by_one(self, last: np.ndarray, ends: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        if not len(ends):
            return
        now, pairs = last.tolist(), self.pairs
        for end, start, i in zip(ends.tolist(), starts.tolist(), ids.tolist(), strict=True):
            if now[end] >= -1:
                continue
            before = now[start]
            if before >= 0:
                key = before << 20 | i
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._apart(before, i)
                if not fits:
                    continue
            elif before == -3:
                continue
            now[end] = i
        last[:] = now

    def _read_back(self, text: str, strings: list[str], begins: np.ndarray, sizes: np.ndarray, short: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Ids of each string, from its end to its beginning; all short strings a step at a time."""
        plain = np.ones(len(strings), dtype=bool)
        at, left = begins + sizes, np.flatnonzero(short)
        owners, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            i = last[at[left]]
            plain[left[i < 0]] = False  # a character without a piece
            left, i = left[i >= 0], i[i >= 0]
            owners.append(left)
            pieces.append(i)
            at[left] -= self.lengths[i]
            left = left[at[left] > begins[left]]
        owner, piece = np.concatenate(owners[::-1]), np.concatenate(pieces[::-1]).astype("<u4")
        flat = piece[np.argsort(owner, kind="stable")].tobytes()
        stops = np.cumsum(np.bincount(owner, minlength=len(strings))) * 4
        out = [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        for k in np.flatnonzero(~(plain & short)).tolist():
            out[k] = self._backwards(text, last, int(begins[k]), int(begins[k] + sizes[k]))
        return out

    def _remembered(self, strings: list[str]) -> list[bytes]:
        distinct = list(dict.fromkeys(strings))
        own = self.known.values(distinct, self.encode_units)
        return own if len(distinct) == len(strings) else list(map(dict(zip(distinct, own, strict=True)).__getitem__, strings))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        offsets, codes, distinct = units(texts)
        # a unit is a space and what follows it; one that is empty or holds the space sign borders on others
        loose = np.array([not u or SPACE in u for u in distinct])
        odd = np.logical_or.reduceat(loose[codes], offsets[:-1])
        parts = self._remembered([SPACE + u for u in distinct])
        lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        flat, begins = np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if odd[k]:
                text = texts[k].as_py() or ""
                own = self._remembered(_RUN.findall(SPACE + text.replace(" ", SPACE))) if text else []
                yield np.frombuffer(b"".join(own), dtype="<u4")
                continue
            own = codes[a:b]
            n = lengths[own]
            ends = np.cumsum(n)
            yield flat[np.repeat(begins[own] - ends + n, n) + np.arange(ends[-1])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes put together, without the space that encoding puts first."""
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, PieceModel] = {}


def loaded(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids (array of int) for every row: the ids the library gives for the byte-pair model at path.

    A null or empty text has no ids. Repeated rows are encoded each, a null doc_id stays null, other
    columns are not read; an empty table gives an empty result.
    """
    ready(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for part in text_slices(batches, limit=SLICE):
            ids = pa.array([x.astype(np.int32) for x in model.encode(part.column("text"))], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, text string, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows (doc_id, ids); null ids give an empty text, ids outside the model fail."""
    ready(rows.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for b in batches:
            texts = [model.decode(np.array(x or [], dtype=np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip: whether decoding gives the text back."""
    ready(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for part in text_slices(batches, limit=SLICE):
            texts, rows = part.column("text").to_pylist(), []
            for text, ids in zip(texts, model.encode(part.column("text")), strict=True):
                back = model.decode(ids) == (text or "").replace(SPACE, " ")
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), back))
            n, crc, back = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back)], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
