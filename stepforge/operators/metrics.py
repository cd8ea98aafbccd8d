"""Scores of predictions and rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_match(steps: DataFrame, key: list[str], step: str, predicted: str, target: str) -> DataFrame:
    """Per episode the steps matched before the first mismatch, those still pending, and success (none pending)."""
    bad = F.min(F.when(~F.col(predicted).eqNullSafe(F.col(target)), F.col(step)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(step)) - 1
    ranked = steps.withColumn(step, place)
    out = ranked.groupBy(*key).agg(F.count("*").alias("total_steps"), bad.alias("_bad"))
    matched = F.coalesce(F.col("_bad").cast("long"), F.col("total_steps"))
    return out.withColumn("matched_steps", matched).withColumn("pending_steps", F.col("total_steps") - matched).withColumn("success", F.col("total_steps") == matched).drop("_bad")


def summary(results: DataFrame, by: list[str], steps: str) -> DataFrame:
    """Episodes, success rate and mean of a step count; zeros without rows."""
    rate = F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)), 6)
    return results.groupBy(*by).agg(F.count("*").alias("episodes"), rate.alias("success_rate"), F.round(F.coalesce(F.avg(steps), F.lit(0.0)), 6).alias(f"mean_{steps}"))


def accuracy(rows: DataFrame, by: list[str], predicted: str, target: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((F.col(predicted) == F.col(target)).cast("double")), 6).alias("accuracy"))


def running_accuracy(rows: DataFrame, key: str, order: str, predicted: str, target: str) -> DataFrame:
    """The accuracy of all rows so far, within key."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_accuracy", F.round(F.avg((F.col(predicted) == F.col(target)).cast("double")).over(so_far), 6))


def rollouts(actions: DataFrame, key: str, order: str, kind: str, goal: str, invalid: str, most: int = 30) -> DataFrame:
    """Per episode, of its first `most` actions: success at the first goal, steps to it (or most), invalid actions before it."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    tried = actions.withColumn("_at", place).filter(F.col("_at") <= most)
    reached = F.min(F.when(F.col(kind) == goal, F.col("_at"))).over(Window.partitionBy(key))
    tried = tried.withColumn("_goal", reached).filter(F.col("_goal").isNull() | (F.col("_at") <= F.col("_goal")))
    return tried.groupBy(key).agg(
        F.max(F.col("_goal").isNotNull()).alias("success"),
        F.coalesce(F.max("_goal"), F.lit(most)).cast("long").alias("steps"),
        F.count_if(F.col(kind) == invalid).alias("invalid_actions"),
        F.count("*").alias("executed_actions"),
    )
