"""Numeric column functions whose rounding and rank rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Rounds to an integer, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def lower_rank(sorted_values: Column, p: float) -> Column:
    """The value at floor(p * (n - 1)) of a sorted array; null for an empty one."""
    return F.get(sorted_values, F.floor(F.lit(p) * (F.size(sorted_values) - 1)).cast("int"))


def counted_rank(histogram: Column, p: float) -> Column:
    """lower_rank of the values of a sorted array of structs (value, n), each as often as n says."""
    upto = F.aggregate(histogram["n"], F.array().cast("array<long>"), lambda a, n: F.array_append(a, n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))))
    place = F.floor(F.lit(p) * (F.coalesce(F.try_element_at(upto, F.lit(-1)), F.lit(1).cast("long")) - 1))
    return F.get(histogram["value"], F.size(F.filter(upto, lambda c: c <= place)))


def seeded_order(seed: int, *keys: str) -> Column:
    """A fixed random order of rows: the hash of seed and keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def l2_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def spaced_picks(length: Column | int, picks: int) -> Column:
    """`picks` integer places spread evenly over 0..length."""
    if picks < 2:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.floor(i * length / F.lit(picks - 1)).cast("int"))


def cyclic_subsets(members: Column, size: int) -> Column:
    """For each place of an array the `size` members that start there, wrapping round."""
    n = F.size(members)
    return F.transform(members, lambda _, i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(members, (i + k) % n)))
