"""Token counts without token ids.

A slice of documents becomes a table of per-document pre-token frequencies (document, pre-token, how often).
Each distinct pre-token is counted once, and the counts live in a table of their own, which a Python worker
keeps over all its slices. The two are joined by the pre-token's code, and frequency times pieces is summed
for each document. The join stays inside the slice, since a document's frequencies are needed nowhere else:
nothing is shuffled, and token ids are never taken out of the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import ready, text_slices
from stepforge.llm.pretokens import SLICE, Vocabulary, loaded, units


def _summed(owner: np.ndarray, code: np.ndarray, n: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (owner, code, n) with n summed up over equal (owner, code), in their order."""
    at, back = np.unique(owner * wide + code, return_inverse=True)
    return at // wide, at % wide, np.bincount(back, weights=n, minlength=len(at)).astype(np.int64)


def frequencies(known: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (document, pre-token code, frequency) of a slice, by document.

    No pre-token crosses a space but one that begins with it, unless white space stands beside: a text in
    which a unit is empty or begins with white space is cut whole."""
    offsets, codes, distinct = units(texts)
    firsts = offsets[:-1]
    heads = np.unique(codes[firsts], return_inverse=True)
    loose = np.array([not u or u[0].isspace() for u in distinct])
    later = np.ones(len(codes), dtype=bool)
    later[firsts] = False
    odd = np.logical_or.reduceat(loose[codes] & later, firsts)
    # units that are not first have their space before them
    fit = np.flatnonzero(~loose)
    rows = known.rows([f" {distinct[i]}" for i in fit.tolist()] + [distinct[i] for i in heads[0].tolist()])
    spaced = np.full(len(distinct), -1)
    spaced[fit] = rows[: len(fit)]
    row = spaced[codes]
    row[firsts] = rows[len(fit) :][heads[1]]
    owner = np.repeat(np.arange(len(firsts)), np.diff(offsets))
    plain = ~odd[owner]
    owner, row, n = _summed(owner[plain], row[plain], np.ones(int(plain.sum())), max(1, len(known.units)))
    code, sizes = known.codes.taken(row)
    owner, n = np.repeat(owner, sizes), np.repeat(n, sizes)
    whole = np.flatnonzero(odd)
    more, sizes = known.pretoken_codes([texts[int(i)].as_py() for i in whole])
    owner, code, n = np.concatenate([owner, np.repeat(whole, sizes)]), np.concatenate([code, more]), np.concatenate([n, np.ones(len(more), np.int64)])
    return _summed(owner, code, n, max(1, len(known.pretokens)))


def slice_counts(known: Vocabulary, texts: pa.Array) -> np.ndarray:
    """Tokens of each text: frequencies joined to the pieces of each pre-token, and summed up."""
    owner, code, n = frequencies(known, texts)
    pieces = known.values.flat[code]
    return np.bincount(owner, weights=n * pieces, minlength=len(texts)).astype(np.int64)


def _counted(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(path, words=False, counts=True)
        for part in text_slices(batches, limit=SLICE):
            texts = pc.fill_null(part.column("text"), "")
            n = slice_counts(known, texts)
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row: tokens as the tokenizers library gives them for the byte-level file at path.

    No begin, end or added tokens, no truncation; special strings inside a text are special tokens, the
    library's default. A null text is an empty one: 0 bytes, 0 tokens. Repeated rows are counted each,
    a null doc_id stays null, other columns are not read, an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
