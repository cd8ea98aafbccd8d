"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every candidate, block by block. A pass lays a histogram of all scores over the
range in which a query's kth score lies; the counts of all blocks are summed up, the bin that holds the kth score
becomes the next range, and so on until a bin is a single integer. What lies above the kth score is then filtered out
of all scores, and of the scores equal to it as many are taken as are still wanted, those with the smallest ids. A block
reports its histogram from the top down to the bin where it has counted as many as are wanted: bins further down
cannot hold the kth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, ready
from stepforge.llm.vectors import block_count, copied, dealt, matrix, usable

#: Bins of a histogram, as a power of two; scores that a task holds at a time.
SCALE, BIN_BITS, HELD = 256, 12, 1 << 22


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where those are exact, else in whole numbers."""
    most = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) for m in (queries, candidates)]
    if most[0] * most[1] < 2**52:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def _scored(queries: pa.Table, candidates: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Queries from row a on, their scores with all candidates of the block, and which of these are other rows."""
    if not queries.num_rows or not candidates.num_rows:
        return
    q, c = matrix(queries.column("vec"), np.int64), matrix(candidates.column("vec"), np.int64)
    own, places = np.asarray(queries.column("place")), np.asarray(candidates.column("place"))
    step = max(1, HELD // len(c))
    for a in range(0, len(q), step):
        yield a, _scores(q[a : a + step], c), own[a : a + step, None] != places


def _histograms(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """place, bin, n: the scores of each query's range, `bins` bins of 2 ** shift from lo on, from the top down until `need` are counted."""
    place, lo, need = (np.asarray(queries.column(n)) for n in ("place", "lo", "need"))
    shift, bins = (queries.column(n)[0].as_py() if queries.num_rows else 0 for n in ("shift", "bins"))
    out: list[tuple[np.ndarray, ...]] = []
    for a, scores, other in _scored(queries, candidates):
        b = slice(a, a + len(scores))
        at = (scores - lo[b, None]) >> shift
        row, col = np.nonzero(other & (at >= 0) & (at < bins))
        n = np.bincount(row * bins + at[row, col], minlength=len(scores) * bins).reshape(-1, bins)
        above = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n
        row, col = np.nonzero((n > 0) & (above < need[b, None]))
        out.append((place[a + row], col, n[row, col]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("place", "bin", "n"), (pa.array(x, pa.int64()) for x in columns), strict=True)))


def _selected(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """Candidates above the kth score, and of those equal to it the `need` with the smallest ids in this block."""
    place, kth, need = (np.asarray(queries.column(n)) for n in ("place", "lo", "need"))
    ids = np.asarray(candidates.column("vec_id"))
    out: list[tuple[np.ndarray, ...]] = []
    for a, scores, other in _scored(queries, candidates):
        b = slice(a, a + len(scores))
        row, col = np.nonzero(other & (scores >= kth[b, None]))
        score = scores[row, col]
        equal = np.flatnonzero(score == kth[a + row])
        equal = equal[np.lexsort((ids[col[equal]], row[equal]))]
        nth = np.arange(len(equal)) - np.searchsorted(row[equal], row[equal])
        keep = np.concatenate([np.flatnonzero(score > kth[a + row]), equal[nth < need[a + row[equal]]]])
        out.append((place[a + row[keep]], ids[col[keep]], score[keep]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("place", "vec_id", "score"), (pa.array(x, pa.int64()) for x in columns), strict=True)))


def kth_scores(asks: DataFrame, most: int, k: int, against) -> DataFrame:
    """place, lo (the kth score), need (how many of the scores equal to it are wanted) for each query; `most` bounds all scores.

    A query with fewer than k candidates wants all: its lo lies below every score."""
    bits = (2 * most + 1).bit_length()
    state = asks.select("place", F.lit(-most).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    while bits:
        shift = max(0, bits - BIN_BITS)
        counts = against(state.withColumn("shift", F.lit(shift)).withColumn("bins", F.lit(1 << (bits - shift))), _histograms, "place long, bin long, n long").groupBy("place", "bin").agg(F.sum("n").alias("n"))
        down = counts.withColumn("above", F.sum("n").over(Window.partitionBy("place").orderBy(F.desc("bin"))) - F.col("n"))
        hit = state.join(down, "place").filter("above < need and above + n >= need")
        state = kept(hit.select("place", F.expr(f"lo + shiftleft(bin, {shift})").alias("lo"), (F.col("need") - F.col("above")).alias("need")), "topk-state")
        bits = shift
    return asks.select("place").join(state, "place", "left").select("place", F.coalesce("lo", F.lit(-most - 1).cast("long")).alias("lo"), F.coalesce("need", F.lit(0).cast("long")).alias("need"))


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x) for queries with vec_id divisible by every.

    Candidates are all rows but the query's own; ties go to the smaller vec_id. Vectors that are null,
    empty or hold null or non-finite components, and rows without vec_id, take no part, nor do vectors whose
    scaled length is 2 ** 31 or more, whose scores a long need not hold; vectors of different lengths are not
    compared. Repeated rows are candidates each. Other columns are not read; an empty table gives an empty result.
    """
    spark = ready(vectors.sparkSession)
    v = F.col("v")
    named = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(v) & F.col("vec_id").isNotNull())
    # components first, so that no square overflows; the floor may lie up to one beyond the component
    short = F.forall(v, lambda x: F.abs(x * scale) < 2.0**31) & (F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * scale) + 1, F.lit(2.0))) < 2.0**62)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("vec")
    rows = kept(named.filter(short).select("vec_id", whole).withColumn("dim", F.size("vec")).withColumn("place", F.monotonically_increasing_id()), "topk-rows")
    asks = rows.filter(F.col("vec_id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, for the cogroup
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, most = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0))).first()
    n_asks = asks.count()
    parallel = spark.sparkContext.defaultParallelism
    c_blocks, q_blocks = block_count(total, 2 * parallel), block_count(n_asks, 1)
    candidates = copied(dealt(rows, "place", c_blocks, "c"), q_blocks, "q").groupBy("dim", "c", "q")

    def against(state: DataFrame, function, schema: str) -> DataFrame:
        queries = copied(dealt(asks.join(state, "place"), "place", q_blocks, "q"), c_blocks, "c").groupBy("dim", "c", "q")
        return queries.cogroup(candidates).applyInArrow(function, schema)

    # no inner product is larger than the largest square; doubles may round it down
    ends = kept(kth_scores(asks, int(most * (1 + 1e-9)) + 1, k, against), "topk-ends")
    found = kept(against(ends, _selected, "place long, vec_id long, score long"), "topk-found")
    order = Window.partitionBy("place").orderBy("vec_id")
    of = found.join(ends, "place").join(asks.select("place", F.col("vec_id").alias("query_id")), "place")
    above = of.filter("score > lo").select("place", "query_id", "vec_id", "score")
    equal = of.filter("score = lo").withColumn("nth", F.row_number().over(order)).filter("nth <= need").select("place", "query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return above.unionByName(equal).withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
