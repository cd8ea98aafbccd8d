"""Approximate nearest neighbours by several shifted Hilbert orderings.

Each curve projects the vectors on its own random directions, shifts them, and orders them by the place of
their cell on a Hilbert curve. The order is cut into equal ranges by quantiles of the keys of all distinct vectors; a
query looks through its own range and its neighbours on either side, the windows of all curves merge, and
the candidates are ranked by their exact inner products. The largest-inner-product search becomes an angular
one by a further component that fills every candidate up to the largest norm.

The share of the rows that a window covers is a parameter, not a number of rows: the recall then holds at
every size, and the work grows with the square of the rows (a fixed part of comparing all). Each vector length
has ranges of its own, fewer where there are few vectors, so that each range holds as many as are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, mixed, ready, seeded
from stepforge.llm.vectors import matrix, usable

#: Curves, projected dimensions and bits of each; ranges of an ordering, and those looked through on either side.
CURVES, DIMENSIONS, BITS, RANGES, REACH = 16, 8, 6, 64, 3
#: Rows of a range at most; beyond it every range is cut into as many finer ones. Queries of a group at most.
RANGE_ROWS, QUERY_ROWS = 16_384, 4_096
_TIE_BITS = 15


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells (n, d) on the d-dimensional Hilbert curve of `bits` bits an axis (Skilling's transposition)."""
    axes = cells.astype(np.int64).T.copy()
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for axis in axes:
            on = (axis & level) != 0
            swap = np.where(on, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(on, low, swap)
            axis ^= swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip, level = np.zeros(axes.shape[1], np.int64), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(axes[-1] & level, level - 1, 0)
        level >>= 1
    axes ^= flip
    key = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """The logistic curve nearest to the normal one; only the order of its values matters."""
    return 1 / (1 + np.exp(-1.702 * np.clip(x, -30, 30)))


def curve_keys(vectors: np.ndarray, fill: np.ndarray, curve: int) -> np.ndarray:
    """Hilbert places of vectors with `fill` as a further component, in the curve's projection and shift."""
    rng = np.random.default_rng([41, curve])
    d = vectors.shape[1] + 1
    k = min(DIMENSIONS, d)
    axes = np.linalg.qr(rng.normal(size=(d, k)))[0]
    shift = rng.random(k) / 2
    full = np.column_stack([vectors, fill])
    norm = np.sqrt((full**2).sum(axis=1, keepdims=True))
    at = _normal_cdf(full @ axes / np.maximum(norm, 1e-300) * np.sqrt(d)) / 2 + shift
    return hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _keyed(unit: float, largest: float | None):
    """Keys on every curve, of vectors in units of the largest component: of candidates, filled up to the largest square norm, or of queries (None), which need no filling."""
    seeds = seeded(CURVES, 43)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, places = b.column("vec"), np.asarray(b.column("place")).astype(np.uint64)
            sizes = np.asarray(pa.compute.list_value_length(lists))
            keys = np.zeros((len(sizes), CURVES), np.int64)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                m = matrix(lists.take(pa.array(own)), np.float64) / unit
                fill = np.zeros(len(own)) if largest is None else np.sqrt(np.maximum(largest - (m**2).sum(axis=1), 0))
                for c in range(CURVES):
                    # vectors of one cell lie in another order on every curve
                    ties = (mixed(places[own] + seeds[c]) >> np.uint64(64 - _TIE_BITS)).astype(np.int64)
                    keys[own, c] = (curve_keys(m, fill, c) << _TIE_BITS) | ties
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * CURVES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=[*b.schema.names, "keys"])

    return key


def _divisions(rows: int, k: int) -> tuple[int, int]:
    """Ranges of an ordering of so many vectors, and how many are looked through on either side.

    A range holds k + 1 vectors at least; a window is the same share of the rows at every size, and one range on either side at least."""
    ranges = max(1, min(RANGES, rows // (k + 1)))
    if ranges < RANGES:
        return ranges, -(-REACH * ranges // RANGES) if ranges > 1 else 0
    finer = max(1, -(-rows // (RANGES * RANGE_ROWS)))
    return RANGES * finer, REACH * finer + (finer - 1) // 2


def _ranges(bounds: dict[int, list[list[int]]], reaches: dict[int, int], asking: bool):
    """For each row its range on every curve, or for queries the first and last of its window."""
    edges = {d: [np.array(x, dtype=np.int64) for x in b] for d, b in bounds.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, sizes = matrix(b.column("keys"), np.int64), np.asarray(pa.compute.list_value_length(b.column("vec")))
            first, last = np.zeros(keys.shape, dtype=np.int32), np.zeros(keys.shape, dtype=np.int32)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                ranges = len(edges[d][0]) + 1
                wide = min(2 * reaches[d], ranges - 1) if asking else 0
                at = np.stack([np.searchsorted(e, keys[own, c], side="left") for c, e in enumerate(edges[d])], axis=1)
                first[own] = np.clip(at - (wide + 1) // 2, 0, ranges - 1 - wide) if asking else at
                last[own] = first[own] + wide
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * CURVES)
            windows = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(first.ravel()), pa.array(last.ravel())], names=["first", "last"]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("place"), b.column("vec"), windows], names=["vec_id", "place", "vec", "ranges"])

    return find


def _ranked(k: int):
    """The k vectors of largest inner product with each query, ties to the smaller vec_id."""

    def rank(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and candidates.num_rows:
            q, c = matrix(queries.column("vec"), np.float64), matrix(candidates.column("vec"), np.float64)
            ids, places = np.asarray(candidates.column("vec_id")), np.asarray(candidates.column("place"))
            order = np.lexsort((places, ids))
            c, ids, places = c[order], ids[order], places[order]
            own = np.asarray(queries.column("place"))
            for a in range(0, len(q), 256):
                with np.errstate(all="ignore"):
                    scores = q[a : a + 256] @ c.T
                for i, row in enumerate(np.where(np.isnan(scores), -np.inf, scores)):
                    some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    some = some[np.argsort(-row[some], kind="stable")[:k]]
                    n = len(some)
                    with np.errstate(all="ignore"):
                        exact = np.einsum("ij,j->i", c[some], q[a + i])
                    out.append((np.full(n, own[a + i]), ids[some], places[some], np.where(np.isnan(exact), -np.inf, exact)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("asked", "vec_id", "found", "score"), map(pa.array, columns), strict=True)))

    return rank


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for queries with vec_id divisible by every, the k nearest found by inner product.

    Candidates are all rows but the query's own, nearest first, ties to the smaller vec_id; all candidates
    are returned if they are fewer. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without vec_id, take no part; vectors of different lengths are not compared. Rows
    with one vector stand on the curves once, with the k + 1 smallest ids (no others can be among anyone's
    nearest), and are looked up once. A score beyond the doubles is infinite, one that is no number counts as
    the least there is (-inf). Other columns are not read; an empty table gives an empty result.
    """
    spark = ready(vectors.sparkSession)
    v = F.col("vec")
    named = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = kept(named.filter(usable(v) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()).withColumn("place", F.monotonically_increasing_id()), "ann-rows")
    unit = rows.agg(F.coalesce(F.max(F.array_max(F.transform(v, F.abs))), F.lit(1.0))).first()[0]
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x / F.lit(unit), F.lit(2.0)))
    largest = rows.agg(F.coalesce(F.max(square), F.lit(0.0))).first()[0]
    tie = F.row_number().over(Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id", "place"))
    first = rows.withColumn("tie", tie).filter(F.col("tie") <= k + 1)
    once = first.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "place"))), 1, k + 1).alias("own"))
    once = once.select(F.col("own")[0]["vec_id"].alias("vec_id"), F.col("own")[0]["place"].alias("place"), "vec", "own")
    own = "own array<struct<vec_id:long,place:long>>"
    keyed = kept(once.mapInArrow(_keyed(unit, float(largest)), f"vec_id long, place long, vec array<double>, {own}, keys array<long>"), "ann-keys")
    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = queries.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.min("place").alias("place")).select("vec_id", "place", "vec")
    asked = kept(asked.mapInArrow(_keyed(unit, None), "vec_id long, place long, vec array<double>, keys array<long>"), "ann-asked")
    dim = F.size("vec").alias("dim")
    plans = {r.dim: _divisions(r.n, k) for r in keyed.groupBy(dim).agg(F.count("*").alias("n")).collect()}
    asks = {r.dim: r.n for r in asked.groupBy(dim).agg(F.count("*").alias("n")).collect()}
    bounds: dict[int, list[list[int]]] = {d: [[] for _ in range(CURVES)] for d in {*plans, *asks}}
    for ranges in {n for n, _ in plans.values() if n > 1}:
        shares = [i / ranges for i in range(1, ranges)]
        own = keyed.filter(F.size("vec").isin([d for d, (n, _) in plans.items() if n == ranges])).groupBy(dim)
        for r in own.agg(*[F.percentile_approx(F.col("keys")[c], shares, 100 * ranges).alias(f"b{c}") for c in range(CURVES)]).collect():
            bounds[r.dim] = [list(b) for b in r[1:]]
    reaches = {d: reach for d, (_, reach) in plans.items()}
    chunks = max([1, *(-(-n * (2 * reaches[d] + 1) // (plans[d][0] * QUERY_ROWS)) for d, n in asks.items())])
    ranged = "vec_id long, place long, vec array<double>, ranges array<struct<first:int,last:int>>"
    candidates = keyed.select("vec_id", "place", "vec", "keys").mapInArrow(_ranges(bounds, reaches, False), ranged).select("vec_id", "place", "vec", dim, F.posexplode("ranges").alias("curve", "at"))
    candidates = candidates.withColumn("range", F.col("at.first")).drop("at").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    windows = asked.mapInArrow(_ranges(bounds, reaches, True), ranged).select("place", "vec", dim, F.posexplode("ranges").alias("curve", "at"))
    windows = windows.withColumn("range", F.explode(F.sequence("at.first", "at.last"))).drop("at").withColumn("chunk", F.pmod(F.xxhash64("place"), F.lit(chunks)).cast("int"))
    keys = ["dim", "curve", "range", "chunk"]
    # of k + 1 vectors one may stand for the query's own row alone
    found = windows.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_ranked(k + 1), "asked long, vec_id long, found long, score double")
    merged = found.groupBy("asked", "vec_id", "found").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "found"))
    merged = merged.withColumn("n", rank).filter(F.col("n") <= k + 1).select("asked", "found", "score")
    copies = merged.join(keyed.select(F.col("place").alias("found"), "own"), "found").select("asked", "score", F.inline("own"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "place"))
    copies = copies.withColumn("n", rank).filter(F.col("n") <= k + 1)
    answers = copies.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "place", "score"))).alias("answers"))
    of = queries.select(F.col("vec_id").alias("query_id"), "place", "vec").join(asked.select("vec", F.col("place").alias("asked")), "vec")
    others = F.slice(F.filter("answers", lambda x: x["place"] != F.col("place")), 1, k)
    out = of.drop("vec").join(answers, "asked").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
