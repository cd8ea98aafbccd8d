"""Packing of token sequences: best-fit start, then swap-based local search over underfull bins.

Documents become pieces of at most `capacity` tokens. A packing depends on lengths alone, of which there are
`capacity` at most, so it is planned for classes: pieces of one length are one class with a count, bins of
the same content are one class with a count. The plan starts best-fit, longest pieces first. Local search then takes
the least filled class of bins and moves its documents to fuller bins, exchanges one for one, or two for one, each
step done for as many bins as both classes have and raising the sum of squared fills, until the bins are empty,
no step is left in a whole sweep, or no packing can have fewer bins. Beyond 100,000 pieces one of several groups of the same
composition is searched for all of them, and then what they leave over. What the plan takes does not grow with the number of pieces. Pieces
find their places by their rank among those of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, ready, text_slices
from stepforge.llm.pretokens import REMEMBERED, SLICE, loaded, spread, units

CAPACITY, END_ID = 4096, 1
#: Pieces that one local search plans for.
GROUP = 100_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"

#: Lengths in a bin with how many there are of each.
Content = dict[int, int]


def slice_ids(path: str, texts: pa.Array, remembered: int = REMEMBERED) -> Iterator[np.ndarray]:
    """The ids of each text in turn: distinct units are encoded once and gathered by code."""
    known = loaded(path, words=True, most=remembered)
    offsets, codes, distinct = units(texts)
    rows = known.rows(distinct)
    pre, n_pre = known.codes.taken(rows)
    flat, n_ids = known.values.taken(pre)
    owner = np.repeat(np.arange(len(distinct)), n_pre)
    lengths = np.bincount(owner, weights=n_ids, minlength=len(distinct)).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = codes[a:b]
        yield flat[spread(begins[own], lengths[own])]


def _pieces(path: str, capacity: int, end_id: int, remembered: int, limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        loaded(path, words=True, most=remembered)  # asked for before the task's slices, it is kept from the task before
        for rows in text_slices(batches, limit=limit):
            out = []
            for doc, ids in zip(rows.column("doc_id").to_pylist(), slice_ids(path, rows.column("text"), remembered), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    own = ids[s : s + capacity]
                    out.append((doc, k, s, len(own), zlib.crc32(own.tobytes()), seen[len(own)]))
                    seen[len(own)] += 1
            doc, k, s, n, crc, nth = zip(*out, strict=True)
            columns = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, crc)), pa.array(np.full(len(k), part, np.int32)), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED, limit: int = SLICE) -> DataFrame:
    """A row per piece: ids of the text by the word tokenizer at path, then end_id, cut after every capacity ids.

    part and nth number the pieces: nth is the number of pieces of the same length before it in its part. A null
    or empty text is the end id alone; repeated rows have pieces each, a null doc_id stays null."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(path, capacity, end_id, remembered, limit), f"{PIECE}, part int, nth long")


def best_fit(counts: Content, capacity: int) -> list[tuple[Content, int]]:
    """Classes of bins: longest first, each piece into the fullest bin with room. A bit of `free` is set where bins with that room exist."""
    done: list[tuple[Content, int]] = []
    by_room: dict[int, list[tuple[Content, int]]] = {}
    free = 0
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            above = free >> n
            if above:
                room = n + (above & -above).bit_length() - 1
                content, bins = by_room[room].pop()
                if not by_room[room]:
                    free ^= 1 << room
            else:
                room, content, bins = capacity, {}, -(-left // (capacity // n))
            each = room // n  # the bin stays the fullest with room until it has taken so many
            full = min(bins, left // each)
            left -= full * each
            some = left if full < bins else 0  # fewer than a bin takes
            left -= some
            for take, number in ((each, full), (some, 1 if some else 0), (0, bins - full - bool(some))):
                if number:
                    rest = room - take * n
                    now = content | {n: take} if take else content
                    if rest:
                        by_room.setdefault(rest, []).append((now, number))
                        free |= 1 << rest
                    else:
                        done.append((now, number))
    return done + [c for room in sorted(by_room) for c in by_room[room]]


class _Search:
    """Classes of underfull bins. Arrays hold a row for each length of each class, so that a step is found in one pass over them."""

    def __init__(self, capacity: int, classes: list[tuple[Content, int]]):
        self.capacity = capacity
        self.contents: list[Content] = []
        self.at: dict[tuple, int] = {}
        self.count, self.fill = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.stuck = np.zeros(64, bool)
        self.length, self.owner, self.rows = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
        self.complete: list[tuple[Content, int]] = []
        self.bins = 0
        for content, n in classes:
            self.put(content, n)
            self.bins += n

    def put(self, content: Content, n: int) -> int:
        """Adds n bins; the number of their class, or -1 for full or empty ones."""
        fill = sum(x * k for x, k in content.items())
        if fill == self.capacity:
            self.complete.append((content, n))
            return -1
        if not fill:
            self.bins -= n
            return -1
        key = tuple(sorted(content.items()))
        c = self.at.get(key)
        if c is None:
            c = self.at[key] = len(self.contents)
            self.contents.append(content)
            for name, size in (("count", c + 1), ("fill", c + 1), ("stuck", c + 1), ("length", self.rows + len(key)), ("owner", self.rows + len(key))):
                old = getattr(self, name)
                if size > len(old):
                    setattr(self, name, np.concatenate([old, np.zeros(size, old.dtype)]))
            self.fill[c] = fill
            self.length[self.rows : self.rows + len(key)] = [x for x, _ in key]
            self.owner[self.rows : self.rows + len(key)] = c
            self.rows += len(key)
        self.count[c] += n
        return c

    def step(self, least: int) -> int | None:
        """One move, or one exchange, of bins of the class with fuller ones; the class that they then are, -1 if empty; None without a step."""
        n = len(self.contents)
        others = (self.count[:n] > 0) & (self.fill[:n] >= self.fill[least])
        others[least] = self.count[least] > 1
        room = self.capacity - self.fill[:n]
        content = self.contents[least]
        longest_first = sorted(content, reverse=True)
        for a in longest_first:
            fits = np.flatnonzero(others & (room >= a))
            if len(fits):
                return self._exchanged(least, {a: 1}, int(fits[room[fits].argmin()]), None)
        owner, length = self.owner[: self.rows], self.length[: self.rows]
        some = others[owner]
        owner, length = owner[some], length[some]
        if not len(owner):
            return None
        reach = length + room[owner]  # what a bin can take for one document of that length
        shortest = np.full(2 * self.capacity + 2, 1 << 40, np.int64)
        np.minimum.at(shortest, reach, length)
        shortest = np.minimum.accumulate(shortest[::-1])[::-1]
        own = np.array(longest_first, dtype=np.int64)
        i, j = np.triu_indices(len(own))
        two = (i != j) | (np.array([content[a] for a in longest_first])[i] > 1)
        i, j = i[two], j[two]
        for given, total in (((own,), own), ((own[i], own[j]), own[i] + own[j])):
            if not len(total):
                continue
            gain = total - shortest[total]
            best = int(gain.argmax())
            if gain[best] > 0:
                back = int(shortest[total[best]])
                to = owner[(length == back) & (reach >= total[best])]
                out: Content = {}
                for lengths in given:
                    out[int(lengths[best])] = out.get(int(lengths[best]), 0) + 1
                return self._exchanged(least, out, int(to[room[to].argmin()]), back)
        return None

    def _exchanged(self, least: int, out: Content, to: int, back: int | None) -> int:
        number = int(min(self.count[least], self.count[to]) if least != to else self.count[least] // 2)
        one, other = dict(self.contents[least]), dict(self.contents[to])
        for x, k in (*out.items(), *([(back, -1)] if back else [])):
            one[x], other[x] = one.get(x, 0) - k, other.get(x, 0) + k
        self.count[least] -= number
        self.count[to] -= number
        self.put({x: k for x, k in other.items() if k}, number)
        return self.put({x: k for x, k in one.items() if k}, number)


def local_search(classes: list[tuple[Content, int]], capacity: int) -> list[tuple[Content, int]]:
    """Empties bins, the least filled first, until a whole sweep over all classes finds no step, or no packing can have fewer bins."""
    bound = -(-sum(x * k * n for content, n in classes for x, k in content.items()) // capacity)
    state, moved = _Search(capacity, classes), False
    while state.bins > bound:
        n = len(state.contents)
        open_ = np.flatnonzero((state.count[:n] > 0) & ~state.stuck[:n])
        if not len(open_):
            if not moved:
                break
            state.stuck[:], moved = False, False  # what has changed since may give a class a step that had none
            continue
        least = int(open_[state.fill[open_].argmin()])
        fuller = (state.fill[:n] >= state.fill[least]) & (state.count[:n] > 0)
        if int((state.count[:n] * (capacity - state.fill[:n]))[fuller].sum()) - (capacity - state.fill[least]) < state.fill[least]:
            state.stuck[least] = True  # the fuller bins together have not the room for one more
            continue
        while least >= 0:
            then = state.step(least)
            if then is None:
                state.stuck[least] = True
                break
            least, moved = then, True
            if state.bins <= bound:
                break
    return state.complete + [(c, int(k)) for c, k in zip(state.contents, state.count, strict=False) if k]


def _bins(plan: list[tuple[Content, int]]) -> int:
    return sum(n for _, n in plan)


def planned(counts: Content, capacity: int, group: int = GROUP) -> list[tuple[Content, int]]:
    """Classes of bins for so many pieces of each length: contents, and how many bins have them.

    Best fit alone is kept if no packing can have fewer bins. Else local search follows; beyond `group` pieces
    it plans one of several groups of the same composition, for all of them at once, and then what is left over."""
    start = best_fit(counts, capacity)
    if _bins(start) * capacity < sum(n * k for n, k in counts.items()) + capacity:
        return start
    total = sum(counts.values())
    if total <= group:
        return local_search(start, capacity)
    parts = -(-total // group)
    share, rest = ({n: k for n, c in counts.items() if (k := f(c, parts))} for f in (int.__floordiv__, int.__mod__))
    found = [(content, n * parts) for content, n in planned(share, capacity, group)] + planned(rest, capacity, group)
    return min(start, found, key=_bins)


_RANK_BITS = 48


def _seats(plan: list[tuple[Content, int]]) -> np.ndarray:
    """Rows (length and first rank as one key, first rank, pieces a bin, first bin, offset), by key: which ranks of a length sit where."""
    rows, given, bins = [], {}, 0
    for content, number in plan:
        offset = 0
        for n in sorted(content, reverse=True):
            first = given.get(n, 0)
            rows.append((n << _RANK_BITS | first, first, content[n], bins, offset))
            given[n] = first + content[n] * number
            offset += n * content[n]
        bins += number
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _seated(seats: np.ndarray):
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = seats[:, 0].copy()
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            _, first, each, bins, offset = seats[np.searchsorted(keys, length << _RANK_BITS | rank, side="right") - 1].T
            own = [pa.array(bins + (rank - first) // each), pa.array(offset + (rank - first) % each * length)]
            names = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *own], names=[*names, "sequence_id", "offset"])

    return seat


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (a kept table as pieces gives it) with sequence_id (gapless from 0) and offset.

    The plan is sent to the tasks; it holds classes of bins, not bins: best fit makes at most two for each length, and
    local search splits those of at most `GROUP` pieces."""
    counts = kept(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    plan = planned({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = rows.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_seated(_seats(plan)), PACKED)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED, limit: int = SLICE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every row of docs.

    A null or empty text is a piece of the end id alone; only documents over capacity are cut. Repeated
    rows are packed each, a null doc_id stays null, other columns are not read, an empty table gives an
    empty result. Of pieces of one length, which goes where depends on how the table is split into tasks. A Python worker remembers that many units
    of the texts, and takes limit bytes of them at a time; fewer take less memory and more time.
    """
    return pack(kept(pieces(docs, path, capacity, end_id, remembered, limit), "pieces"), capacity)
