"""Coverage of scenes by classes, candidate tasks, quotas and greedy covers."""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.stats import seeded_order
from stepforge.operators import ranking


def coverage(members: DataFrame, scene: str, name: str) -> DataFrame:
    """name, coverage: the scenes that hold it."""
    return members.groupBy(name).agg(F.countDistinct(scene).alias("coverage"))


def coverage_rank(members: DataFrame, scene: str, name: str) -> DataFrame:
    """Coverage with its rank: most scenes first, then by name."""
    return ranking.placed(coverage(members, scene, name), [F.desc("coverage"), F.col(name)], "_at").withColumn("rank", (F.col("_at") + 1).cast("int")).drop("_at")


def joint_coverage(left: DataFrame, right: DataFrame, scene: str, a: str, b: str) -> DataFrame:
    """Pairs (a, b) of different names with the number of scenes that hold both; found by joining on the scene, never by a cross join."""
    pairs = left.select(scene, F.col(a)).distinct().join(right.select(scene, F.col(b)).distinct(), scene).filter(F.col(a) != F.col(b))
    return pairs.groupBy(a, b).agg(F.count("*").alias("joint"))


def top_pairs(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """The pairs with the largest joint coverage, then by name, with their rank."""
    place = F.row_number().over(Window.orderBy(F.desc("joint"), a, b))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= most)


def without_pairs(pairs: DataFrame, taken: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.join(taken.select(a, b), [a, b], "left_anti")


def quotas(counts: dict[str, int], total: int, of: int) -> dict[str, int]:
    """total shared in proportion to counts out of `of`: at least one each, half-even, then the largest give or take what is over or short."""
    out = {k: max(1, round(total * n / of)) for k, n in counts.items()}
    order = sorted(out, key=lambda k: (-out[k], k))
    while order and (over := sum(out.values()) - total):
        before = dict(out)
        for k in order:
            if not over:
                break
            if over < 0 or out[k] > 1:
                step = 1 if over < 0 else -1
                out[k] += step
                over += step
        if out == before:  # every family is at its least
            break
    return out


def greedy_cover(tasks: list[tuple[str, list[str], list[str]]], quota: int, seen: set[str]) -> list[str]:
    """quota tasks, each the one that covers most seen scenes not covered yet; then most seen, most unseen, most scenes, first in order.

    tasks holds (name, scenes where it is valid) in order: a bounded plan, a row per task. What a task would add only shrinks, so a heap holds what each added when it was last
    looked at, and only the tasks that come to its top are looked at again; scenes are bits of one number. Fewer tasks than the quota are an error."""
    if len(tasks) < quota:
        raise ValueError(f"{quota} tasks asked of {len(tasks)}")
    bit = {s: 1 << i for i, s in enumerate(sorted(seen))}
    own = [sum(bit[s] for s in set(valid) if s in bit) for _, valid, _ in tasks]
    heap = [(-own[at].bit_count(), -own[at].bit_count(), -len(set(valid) - seen), -len(valid), at) for at, (_, valid, _) in enumerate(tasks)]
    heapify(heap)
    covered, chosen = 0, []
    while len(chosen) < quota:
        gain, *rest, at = heap[0]
        now = -(own[at] & ~covered).bit_count()
        if now > gain:
            heapreplace(heap, (now, *rest, at))
            continue
        heappop(heap)
        covered |= own[at]
        chosen.append(tasks[at][0])
    return chosen


def unseen_order(tasks: DataFrame, unseen: str, valid: str, order: str) -> DataFrame:
    """Rank of tasks for the unseen part: most unseen scenes, most valid scenes, first in order."""
    return ranking.placed(tasks, [F.desc(unseen), F.desc(valid), F.col(order)], "_at").withColumn("rank", (F.col("_at") + 1).cast("int")).drop("_at")


def held_out_order(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """place: rows in a seeded order, then by their group's name, a stable sort of a shuffle."""
    return ranking.placed(rows.withColumn("_hash", seeded_order(seed, key)), [group, "_hash", key], "place").drop("_hash")


def within_quota(candidates: DataFrame, group: str, order: list[Column | str], quota: Column | int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return candidates.withColumn("_at", place).filter(F.col("_at") <= quota).drop("_at")


def probed(scenes: DataFrame, attempts: DataFrame, base: str, scene: str, need: int, most: int, quota: Column | int) -> DataFrame:
    """Scenes with at least `need` successes in their first `most` attempts, at most quota per base by name."""
    place = F.row_number().over(Window.partitionBy(scene).orderBy("attempt"))
    good = attempts.withColumn("_at", place).filter(F.col("_at") <= most).groupBy(scene).agg(F.count_if("ok").alias("ok")).filter(F.col("ok") >= need)
    return within_quota(scenes.join(good, scene), base, [scene], quota)
