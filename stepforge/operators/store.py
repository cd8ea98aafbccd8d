"""Edits of a store of models, a small table (pos, model, …) whose places count from 0. Negative places count from the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators.retrieval import TOP, nearest_models


def _renumbered(store: DataFrame) -> DataFrame:
    return store.withColumn("pos", (F.row_number().over(Window.orderBy("pos")) - 1).cast("int"))  # a row per model


def inserted(store: DataFrame, at: int, row: DataFrame) -> DataFrame:
    """A model (all columns but pos) before the place; places beyond either end are the ends."""
    n = store.count()
    at = min(max(at + n if at < 0 else at, 0), n)
    moved = store.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + 1).otherwise(F.col("pos")))
    return moved.unionByName(row.withColumn("pos", F.lit(at)))


def popped(store: DataFrame, at: int = -1) -> tuple[DataFrame, DataFrame]:
    """The model at a place, and the store without it."""
    n = store.count()
    if not -n <= at < n:
        raise IndexError(f"place {at} of {n} models")
    at %= n
    rest = store.filter(F.col("pos") != at).withColumn("pos", F.when(F.col("pos") > at, F.col("pos") - 1).otherwise(F.col("pos")))
    return store.filter(F.col("pos") == at), rest


def removed(store: DataFrame, model: str) -> DataFrame:
    return _renumbered(store.filter(~F.col("model").eqNullSafe(model)))


def backwards(store: DataFrame) -> DataFrame:
    return store.withColumn("pos", F.lit(store.count() - 1) - F.col("pos"))


def sliced(store: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """The models at the places of a slice, in its order."""
    places = list(range(store.count()))[start:stop:step]
    at = F.array_position(F.array(*map(F.lit, places)) if places else F.array().cast("array<int>"), F.col("pos"))
    return store.filter(at > 0).withColumn("pos", (at - 1).cast("int"))


def extended(store: DataFrame, more: DataFrame) -> DataFrame:
    return store.unionByName(more.withColumn("pos", F.col("pos") + F.lit(store.count())))


def selected_models(queries: DataFrame, fixed: list[str], protos: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """query, rank, model: the k models with the nearest prototypes, or the fixed ones in their order where there are no prototypes."""
    if protos is not None:
        return nearest_models(protos, queries, k).select("query", "rank", "model")
    kind = queries.schema["model"].dataType.simpleString()
    listed = F.posexplode(F.array(*[F.lit(m).cast(kind) for m in fixed])) if fixed else F.posexplode(F.array().cast(f"array<{kind}>"))
    return queries.select(F.col("model").alias("query")).distinct().select("query", listed.alias("rank", "model")).withColumn("rank", F.col("rank") + 1)
