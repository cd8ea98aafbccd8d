"""Prototype sets of vectors and retrieval by optimal-transport distance."""

from __future__ import annotations

from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stepforge.functions.stats import l2_distance
from stepforge.session import cut, ready

#: Vectors of a model that prototypes are chosen from at most (a part of the reference's rule), prototypes, and models returned.
FIRST, PROTOTYPES, TOP = 1024, 15, 3


def mean_vectors(vectors: DataFrame, by: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """by, pos, mean: the weighted mean of each component; a group without weight has zeros."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = vectors.select(*by, w.alias("_w"), F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    return long.groupBy(*by, "pos").agg((F.sum(F.col("x") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1.0))).alias("mean"))


def against_all(queries: DataFrame, query: str, others: DataFrame, other: str, rows: int = 4096) -> DataFrame:
    """Every query beside every other row, in blocks: others are dealt into blocks of about `rows`, queries into parts, and each block meets each part in a group of its own."""
    blocks, parts = max(1, -(-others.count() // rows)), queries.sparkSession.sparkContext.defaultParallelism
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_part", F.pmod(F.xxhash64(query), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))
    right = others.withColumn("_block", F.pmod(F.xxhash64(other), F.lit(blocks)).cast("int")).withColumn("_part", every(parts))
    return left.join(right, ["_block", "_part"]).drop("_block", "_part")


def nearest_means(queries: DataFrame, means: DataFrame, k: int) -> DataFrame:
    """query, model, distance, rank of the k nearest mean vectors, ties to the smaller model.

    queries (query, vec), means (model, vec): one row per model, so the pairs are queries times models."""
    pairs = against_all(queries, "query", means.select("model", F.col("vec").alias("_m")), "model")
    far = pairs.select("query", "model", l2_distance(F.col("vec"), F.col("_m")).alias("distance"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "model"))
    return far.withColumn("rank", place).filter(F.col("rank") <= k)


def farthest_points(x: np.ndarray, k: int) -> list[int]:
    """Indices of k rows: the first, then again and again the one farthest from those chosen (first of equals)."""
    if not len(x):
        raise ValueError("no vectors to choose prototypes from")
    chosen = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
    return chosen


def prototypes(vectors: DataFrame, model: str, order: str, vec: str, k: int = PROTOTYPES, first: int = FIRST) -> DataFrame:
    """model, pos, id, vec: k-center prototypes of the first vectors of each model in order."""
    ready(vectors.sparkSession)
    place = F.row_number().over(Window.partitionBy(model).orderBy(order))
    some = vectors.select(F.col(model).cast("long").alias("model"), F.col(order).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), place.alias("_at")).filter(F.col("_at") <= first)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        at = farthest_points(np.stack(pdf["vec"].to_numpy()), k)
        return pd.DataFrame({"model": pdf["model"].iloc[at], "pos": range(len(at)), "id": pdf["id"].iloc[at], "vec": pdf["vec"].iloc[at]})

    return some.groupBy("model").applyInPandas(choose, "model long, pos int, id long, vec array<double>")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Columns of the least-cost assignment of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    of_col = np.full(n + 1, -1)
    u, v = np.zeros(n), np.zeros(n + 1)
    for row in range(n):
        best, via, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        of_col[n], at = row, n
        while of_col[at] >= 0:
            done[at] = True
            r = of_col[at]
            reach = cost[r] - u[r] - v[:n]
            closer = (reach < best) & ~done[:n]
            best[closer], via[closer] = reach[closer], at
            open_ = np.where(done[:n], np.inf, best)
            step, to = open_.min(), int(open_.argmin())
            u[of_col[done]] += step
            v[done] -= step
            best[~done[:n]] -= step
            at = to
        while at != n:
            of_col[at] = of_col[via[at]]
            at = via[at]
    out = np.empty(n, dtype=np.int64)
    out[of_col[:n]] = np.arange(n)
    return out


def transport(a: np.ndarray, b: np.ndarray) -> float:
    """Wasserstein-1 distance of two sets of equally weighted points; unequal sizes are brought to their least common multiple."""
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    n = lcm(len(a), len(b))
    cost = np.repeat(np.repeat(cost, n // len(a), axis=0), n // len(b), axis=1)
    return float(cost[np.arange(n), assignment(cost)].mean())


def _mean(sets: Column) -> Column:
    """The mean of an array of vectors."""
    total = F.aggregate(F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(1))), sets[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(sets))


def nearest_models(protos: DataFrame, queries: DataFrame, k: int = TOP, seen: Observation | None = None) -> DataFrame:
    """query, rank, model, distance: the k models whose prototypes are nearest to each query's, ties to the smaller model.

    Both hold (model, vec), a bounded set per model. The distance of two sets' means is never more than their transport distance, and costs next to
    nothing. So the k models of least bound are compared exactly; the kth distance found rules out all models whose bound is beyond it, and the rest are compared too. seen
    observes how many pairs were compared exactly (exact) of how many there are (pairs)."""
    ready(protos.sparkSession)
    sets = cut(protos.groupBy("model").agg(F.array_sort(F.collect_list("vec")).alias("a")))
    asked = cut(queries.groupBy(F.col("model").alias("query")).agg(F.array_sort(F.collect_list("vec")).alias("b")))
    means = against_all(asked.select("query", _mean(F.col("b")).alias("mb")), "query", sets.select("model", _mean(F.col("a")).alias("ma")), "model")
    bounds = means.select("query", "model", l2_distance(F.col("ma"), F.col("mb")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("bound", "model"))
    bounds = cut(bounds.withColumn("place", place))

    @F.pandas_udf("double")
    def far(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([transport(np.stack(x), np.stack(y)) for x, y in zip(a, b, strict=True)])

    def exact(pairs: DataFrame) -> DataFrame:
        return cut(pairs.join(sets, "model").join(asked, "query").select("query", "model", far("a", "b").alias("distance")))

    first = exact(bounds.filter(F.col("place") <= k))
    kth = first.groupBy("query").agg(F.max("distance").alias("kth"))
    # a little room, since distances that agree to nine places are equal
    rest = exact(bounds.filter(F.col("place") > k).join(kth, "query").filter("bound <= kth * (1 + 1e-9) + 1e-8"))
    every = first.unionByName(rest)
    if seen is not None:
        bounds.join(every.select("query", "model", F.lit(True).alias("exact")), ["query", "model"], "left").observe(seen, F.count(F.lit(1)).alias("pairs"), F.count("exact").alias("exact")).write.format("noop").mode("append").save()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "model"))
    return every.withColumn("rank", place).filter(F.col("rank") <= k)


def meta_update(old: DataFrame, models: DataFrame, beta: float) -> DataFrame:
    """pos, value: old + beta * (mean over models - old), by position; both hold (pos, value)."""
    mean = models.groupBy("pos").agg(F.avg("value").alias("_mean"))
    return old.join(mean, "pos").select("pos", (F.col("value") + F.lit(beta) * (F.col("_mean") - F.col("value"))).alias("value"))

