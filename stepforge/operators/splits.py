"""Seen and unseen splits, holdouts, samples and clusters. Random orders are hashes of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.stats import half_even, seeded_order
from stepforge.operators import ranking


def seen_tags(rows: DataFrame, task: str, scene: str, unseen_tasks: list[str], unseen_scenes: list[str]) -> DataFrame:
    """task_split, scene_split, their quadrant, and whether zero-shot training may use the row."""
    tag = lambda c, unseen: F.when(F.col(c).isin(unseen), "unseen").otherwise("seen")
    out = rows.withColumn("task_split", tag(task, unseen_tasks)).withColumn("scene_split", tag(scene, unseen_scenes))
    return out.withColumn("quadrant", F.concat_ws("_", "task_split", "scene_split")).withColumn("zero_shot", F.col("quadrant") == "seen_seen")


def room_of(number: Column, ranges: list[tuple[int, int, str]], strict: bool = False) -> Column:
    """The room whose range holds the number; null, or with strict an error, if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, room in ranges:
        out = out.when(number.between(lo, hi), room)
    return out.otherwise(F.raise_error(F.concat(F.lit("no room for "), number.cast("string")))) if strict else out


def three_way(rows: DataFrame, strata: list[str], key: str, eval_share: float, monitor_share: float, seed: int) -> DataFrame:
    """split: eval, monitor or train, carved from each stratum in hashed order.

    Shares are rounded half to even; a stratum of 20 or more gives at least one to each; training keeps at least one row."""

    def cuts(n: Column) -> list[Column]:
        least = F.when(n >= 20, 1).otherwise(0)
        e, m = F.greatest(half_even(n * eval_share), least), F.greatest(half_even(n * monitor_share), least)
        tight = e + m >= n
        e = F.when(tight, F.greatest(F.lit(0), F.least(e, n - 1))).otherwise(e)
        m = F.when(tight, F.greatest(F.lit(0), F.least(m, n - e - 1))).otherwise(m)
        return [e, e + m]

    of = F.element_at(F.array(*map(F.lit, ("eval", "monitor", "train"))), F.col("_class") + 1)
    return ranking.classed(rows, strata, key, seed, cuts, "_class").withColumn("split", of).drop("_class")


def holdout(rows: DataFrame, by: list[str], key: str, share: float, seed: int) -> DataFrame:
    """held_out: in each group the first max(1, half-even(n * share)) rows in hashed order."""
    return ranking.classed(rows, by, key, seed, lambda n: [F.greatest(F.lit(1), half_even(n * share))], "_class").withColumn("held_out", F.col("_class") == 0).drop("_class")


def exact_holdout(rows: DataFrame, by: list[str], key: str, held: int, seed: int) -> DataFrame:
    """held_out for exactly `held` rows, shared among groups in proportion by largest remainders, in hashed order within each; more than there are rows is an error."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n")) if by else rows.agg(F.count("*").alias("_n"))
    have = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if have < held:
        raise ValueError(f"{held} rows asked of {have}")
    quota = ranking.allotted(counts, "_n", held).drop("_n")
    if by:
        named = rows.alias("r").join(quota.alias("q"), ranking._same("r", "q", by)).select("r.*", "q.quota")
    else:
        named = rows.withColumn("quota", F.lit(held).cast("long"))
    # the quota is a group's, so it is one of the grouping columns
    return ranking.classed(named, [*by, "quota"], key, seed, lambda n: [F.least(n, F.col("quota"))], "_class").withColumn("held_out", F.col("_class") == 0).drop("_class", "quota")


def sample_per_group(rows: DataFrame, by: list[str], key: str, most: int, seed: int) -> DataFrame:
    """The first `most` rows of each group in hashed order."""
    return ranking.classed(rows, by, key, seed, lambda n: [F.least(n, F.lit(most))], "_class").filter("_class = 0").drop("_class")


def select_samples(rows: DataFrame, key: str, most: int | None, seed: int) -> DataFrame:
    """All rows if most is None or negative, else the first `most` in hashed order."""
    return rows if most is None or most < 0 else rows.orderBy(seeded_order(seed, key), key).limit(most)


def protected_downsample(rows: DataFrame, key: str, quadrant: str, task: str, scene: str, target: int, order: list[str], seed: int) -> DataFrame:
    """kept: protected rows (seen_seen, the first of each task and of each scene) and others until target rows are left.

    Removal goes through `order` of quadrants, in hashed order within each. More protected rows than target is an error."""
    firsts = [rows.groupBy(c).agg(F.min(key).alias("_key")).select("_key") for c in (task, scene)]  # counted before the shuffle, so no task holds a frequent one
    firsts = firsts[0].union(firsts[1]).distinct().withColumn("_first", F.lit(True))
    flagged = rows.join(firsts, F.col(key) == F.col("_key"), "left").withColumn("_p", (F.col(quadrant) == "seen_seen") | F.coalesce("_first", F.lit(False))).drop("_key", "_first")
    total, protected = flagged.agg(F.count("*"), F.count_if("_p")).first()
    if protected > target < total:
        raise ValueError(f"{protected} protected rows, but the target is {target}")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(quadrant)), F.lit(0))
    # ranks are counted over hash ranges first, so that no task sorts all rows
    free = flagged.filter(~F.col("_p")).withColumn("_rank", rank).withColumn("_hash", seeded_order(seed, key)).withColumn("_part", F.substring("_hash", 1, 2))
    counts = free.groupBy("_rank", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_rank", "_part")) - F.col("_n")).select("_rank", "_part", "_before")
    place = F.row_number().over(Window.partitionBy("_rank", "_part").orderBy("_hash", key)) + F.col("_before")
    free = free.join(F.broadcast(before), ["_rank", "_part"]).withColumn("kept", place > max(0, total - target))  # at most 256 rows a quadrant
    columns = rows.columns
    return free.select(*columns, "kept").union(flagged.filter("_p").select(*columns, F.lit(True).alias("kept")))


def _levelled(used: dict, room: dict, take: int) -> dict:
    """How many of `take` picks each scene gets if every pick goes to the scene used least so far (first name of equals) that has room."""
    take = min(take, sum(room.values()))
    given = lambda level: {s: min(max(level - used.get(s, 0), 0), room[s]) for s in room}
    lo, hi = 0, max(used.values(), default=0) + take + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(given(mid).values()) <= take else (lo, mid)
    out = given(lo)
    rest = take - sum(out.values())
    for s in sorted(s for s in room if out[s] < room[s] and used.get(s, 0) + out[s] == lo)[:rest]:
        out[s] += 1
    return out


def eval_spread(rows: DataFrame, task: str, scene: str, key: str, per_task: int) -> DataFrame:
    """task, scene, key of rows held out: of each task in turn at most per_task rows, each from the scene used least so far, the first of equals.

    The running use of scenes is global, so tasks go one after another; but a scene gives its rows in order of
    key, so the decisions need the counts of (task, scene) alone, and the rows are then chosen where they are."""
    own = rows.select(F.col(task).alias("task"), F.col(scene).alias("scene"), F.col(key).alias("key"))
    counts: dict = {}
    for r in own.groupBy("task", "scene").count().collect():  # a row per task and scene
        counts.setdefault(r.task, {})[r.scene] = r["count"]
    used: dict = {}
    quota = []
    for t in sorted(counts):
        for s, n in _levelled(used, counts[t], max(0, per_task)).items():
            used[s] = used.get(s, 0) + n
            quota.append((t, s, n))
    kind = own.schema
    quotas = rows.sparkSession.createDataFrame(quota, f"task {kind['task'].dataType.simpleString()}, scene {kind['scene'].dataType.simpleString()}, quota long")
    place = F.row_number().over(Window.partitionBy("task", "scene").orderBy("key"))
    return own.join(quotas, ["task", "scene"]).withColumn("place", place).filter("place <= quota").select("task", "scene", "key")


def task_room_matrix(rows: DataFrame, task: str, room: str, tasks: list[str], rooms: list[str]) -> DataFrame:
    """A row for each task and a count for each room, zero where there are none; other tasks and rooms are left out."""
    all_ = rows.sparkSession.createDataFrame([(t,) for t in tasks], f"`{task}` string")
    return all_.join(rows.groupBy(task).pivot(room, rooms).count(), task, "left").na.fill(0, rooms)
