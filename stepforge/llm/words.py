"""Hashes of words and of word shingles, for a whole slice of texts at once."""

from __future__ import annotations

import numpy as np

from stepforge.llm.common import mixed, seeded

_BYTE = seeded(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and every byte of a character beyond ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a newline, and where each text begins (with the end as last entry)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8), starts


def runs(data: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs without ASCII white space, or with terms runs of letters, digits and non-ASCII bytes."""
    inside = _TERM[data] if terms else ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with lower A-Z taken as a-z: differences of one prefix sum over the slice."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width hashes, by the place where it starts."""
    n = max(0, len(hashes) - width + 1)
    up, down = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mixed((sums[width : width + n] - sums[:n]) * down[:n])


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values: minima from both ends of blocks of width."""
    n = max(0, len(values) - width + 1)
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


_PLACE = seeded(6, 12) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of width words; of fewer words the whole sequence is one shingle."""
    data, bounds = joined(texts)
    starts, ends = runs(data)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    places = _PLACE if width <= 5 else seeded(width + 1, 12) | np.uint64(1)
    windows = max(0, len(hashes) - width + 1)
    sums = np.zeros(windows, dtype=np.uint64)
    for k in range(width):
        sums += hashes[k : k + windows] * places[k]
    sums = mixed(sums)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(sums[a : b - width + 1]))
        elif b > a:
            short = np.append(hashes[a:b] * places[: b - a], places[width : width + 1] * np.uint64(b - a))
            out.append(mixed(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
