"""Audits of splits and releases: leakage, equality of multisets, rules, replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.operators import membership


def overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: n, the distinct keys on both sides."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_semi").agg(F.count("*").alias("n"))


def leakage(train: DataFrame, held: DataFrame, checks: dict[str, list[str]]) -> DataFrame:
    """check, n for every named key: distinct values that both sides hold."""
    of = membership.Views(["train", "held"])
    keys = {name: F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in on]), F.to_json(F.struct(*[F.col(c) for c in on]))) for name, on in checks.items()}
    columns = list(dict.fromkeys(c for on in checks.values() for c in on))
    masks = of.masks(membership.union({"train": train.select(*columns), "held": held.select(*columns)}, "_view"), keys, "_view")
    rules = [(name, "held", "error", of.shared(name, ["train"], ["held"]), F.col("n") > 0) for name in checks]
    return membership.counted(masks, rules).select(F.col("rule").alias("check"), "n")


def multiset_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose counts differ, with both counts; empty if the multisets are equal. Nulls are equal to each other."""
    both = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*on).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).filter("n_left <> n_right")


def rule_report(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """rule, severity, n: rows that break each rule, counted in one pass."""
    counts = rows.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, _, broken in rules])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(name).alias("n")) for name, severity, _ in rules])))


def valid(report: DataFrame) -> DataFrame:
    """One row: valid, whether no error rule is broken."""
    return report.agg(F.coalesce(F.bool_and((F.col("severity") != "error") | (F.col("n") == 0)), F.lit(True)).alias("valid"))


def strict_lookup(rows: DataFrame, dim: DataFrame, key: str, other: str, agree: Column) -> DataFrame:
    """reason, n of a lookup that must succeed: 'ok', 'missing' (no such key) or 'mismatch' (a row that does not agree)."""
    joined = rows.join(dim, F.col(key) == F.col(other), "left")
    reason = F.when(F.col(other).isNull(), "missing").when(~agree, "mismatch").otherwise("ok")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_at = 1").drop("_at")


def unchanged(steps: DataFrame, key: str, order: str, verb: str, state: str) -> DataFrame:
    """verb, total, unchanged: transitions to the next step of the key that leave the state as it was; verbs without any are left out."""
    following = F.lead(state).over(Window.partitionBy(key).orderBy(order))
    pairs = steps.withColumn("_next", following).filter(F.col("_next").isNotNull())
    return pairs.groupBy(verb).agg(F.count("*").alias("total"), F.count_if(F.col("_next") == F.col(state)).alias("unchanged")).filter("unchanged > 0")


def replay_mismatches(stored: DataFrame, replayed: DataFrame, key: list[str], text: str, by: list[str]) -> DataFrame:
    """Stored steps, those without a replay, and those whose replayed text differs, by group."""
    both = stored.join(replayed.select(*key, F.col(text).alias("_replayed"), F.lit(True).alias("_has")), key, "left")
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_has").isNull()).alias("missing"),
        F.count_if(F.col("_has") & ~F.col("_replayed").eqNullSafe(F.col(text))).alias("mismatched"),
    )


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows only in one of two sets, marked missing or extra."""
    return expected.subtract(actual).withColumn("side", F.lit("missing")).union(actual.subtract(expected).withColumn("side", F.lit("extra")))
