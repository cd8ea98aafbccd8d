"""Episodes: assembling steps, expanding them into training samples, rendering chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of an episode that cumulative samples go up to.
CAP = 30


def assembled(steps: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key: n_steps and steps, an array of structs in step order."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order])))
    return steps.groupBy(key).agg(F.count("*").alias("n_steps"), items.alias("steps"))


def contiguity(steps: DataFrame, key: str, step: str, first: int = 0) -> DataFrame:
    """Per key whether its steps are first, first + 1, ... without gaps or repeats."""
    n = F.count("*")
    return steps.groupBy(key).agg(
        n.alias("n_steps"),
        F.countDistinct(step).alias("n_distinct"),
        ((F.min(step) == first) & (F.max(step) == n + (first - 1)) & (F.countDistinct(step) == n)).alias("contiguous"),
    )


def with_length(steps: DataFrame, key: str) -> DataFrame:
    return steps.withColumn("num_steps", F.count("*").over(Window.partitionBy(key)))


def cumulative_samples(episodes: DataFrame, key: str, items: str = "steps", result: str = "observation", cap: int = CAP) -> DataFrame:
    """For each of the first cap steps two samples: the steps so far, the last one's result null ('action') or kept ('full')."""
    upto = episodes.select(key, F.col(items), F.explode(F.sequence(F.lit(1), F.least(F.size(items), F.lit(cap)))).alias("t")).filter(F.size(items) > 0)
    so_far = upto.select(key, (F.col("t") - 1).alias("step"), F.slice(items, F.lit(1), F.col("t")).alias("history"))
    hidden = F.transform("history", lambda s, i: F.when(i == F.size("history") - 1, s.withField(result, F.lit(None))).otherwise(s))
    variants = F.array(F.struct(F.lit("action").alias("variant"), hidden.alias("history")), F.struct(F.lit("full").alias("variant"), F.col("history")))
    return so_far.select(key, "step", F.inline(variants))


def final_samples(episodes: DataFrame, key: str, items: str = "steps", result: str = "observation", end_with_action: bool = True) -> DataFrame:
    """One sample per episode: all its steps, the last result null if the sample ends with an action."""
    history = F.col(items)
    if end_with_action:
        history = F.transform(items, lambda s, i: F.when(i == F.size(items) - 1, s.withField(result, F.lit(None))).otherwise(s))
    return episodes.select(key, history.alias("history"))


def transition_samples(rows: DataFrame, result: str) -> DataFrame:
    """Each row twice: without its result ('action') and with it ('full')."""
    kind = F.explode(F.array(F.lit("action"), F.lit("full")))
    return rows.withColumn("variant", kind).withColumn(result, F.when(F.col("variant") == "full", F.col(result)))


def messages(steps: Column, role: str = "role", content: str = "text") -> Column:
    return F.transform(steps, lambda s: F.struct(s[role].alias("role"), s[content].alias("content")))
