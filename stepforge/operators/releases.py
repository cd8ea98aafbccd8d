"""Building releases: candidate tasks, balanced scenes, clusters with monitor rows, views, re-splits and evaluation variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.stats import seeded_order
from stepforge.operators import planning, ranking, splits
from stepforge.session import ready

#: Combinations scored at once.
_BLOCK = 50_000


def candidates(members: DataFrame, properties: DataFrame, goals: dict[str, int], multiplier: int = 12, no_goals: tuple[str, ...] = (), no_surfaces: tuple[str, ...] = ()) -> DataFrame:
    """family, args, place: tasks of all four families by how many scenes can hold them.

    members (scene, class), properties (class, property). turnon and open take every class with HAS_SWITCH or CAN_OPEN in
    order of coverage; puton and placein take pairs of a GRABBABLE class and one of SURFACES or CONTAINERS in order of
    joint coverage, at most max(goal * multiplier, goal + 20) of them; a pair of puton is none of placein."""
    owned = members.select("scene", "class").distinct()

    def having(name: str, without: tuple[str, ...] = ()) -> DataFrame:
        own = owned.join(properties.filter(F.col("property") == name).select("class").distinct(), "class", "left_semi")
        return own.filter(~F.col("class").isin(*without)) if without else own

    def single(family: str, name: str) -> DataFrame:
        ranked = planning.coverage_rank(having(name, no_goals), "scene", "class")
        return ranked.select(F.lit(family).alias("family"), F.array("class").alias("args"), F.col("rank").alias("place"))

    def pairs(name: str, without: tuple[str, ...]) -> DataFrame:
        hosts = having(name, without).withColumnRenamed("class", "host")
        return planning.joint_coverage(having("GRABBABLE"), hosts, "scene", "class", "host")

    def best(rows: DataFrame, goal: int) -> DataFrame:
        return planning.top_pairs(rows, "class", "host", max(goal * multiplier, goal + 20))

    named = lambda rows, family: rows.select(F.lit(family).alias("family"), F.array("class", "host").alias("args"), F.col("rank").alias("place"))
    on = best(pairs("SURFACES", (*no_goals, *no_surfaces)), goals["puton"])
    inside = best(planning.without_pairs(pairs("CONTAINERS", no_goals), on, "class", "host"), goals["placein"])
    return single("turnon", "HAS_SWITCH").unionByName(single("open", "CAN_OPEN")).unionByName(named(on, "puton")).unionByName(named(inside, "placein"))


def _scored(table: np.ndarray, scenes: np.ndarray, first: int, k: int) -> tuple | None:
    """The best combination of k scenes whose first is scenes[first], as a tuple that is smaller the better it is."""
    target = np.maximum(1.0, table.sum(axis=0) * k / len(scenes))
    rest, best = combinations(range(first + 1, len(scenes)), k - 1), None
    while block := list(islice(rest, _BLOCK)):
        picked = np.column_stack([np.full(len(block), first), np.array(block, dtype=int).reshape(len(block), k - 1)])
        sums = table[picked].sum(axis=1)
        off = np.round((np.abs(sums - target) / target).sum(axis=1), 9)
        keys = (-(sums > 0).sum(axis=1), -sums.min(axis=1), off, -sums.sum(axis=1), scenes[picked].sum(axis=1))
        at = np.lexsort(keys[::-1])[0]  # stable: of equals the first
        found = (*(key[at].item() for key in keys), scenes[picked[at]].tolist())
        best = found if best is None or found < best else best
    return best


def balanced_scenes(counts: DataFrame, fraction: float) -> DataFrame:
    """room, scenes: of each room the max(1, half-even(scenes * fraction)) scenes that cover its tasks best.

    counts (room, scene int, task, n) has a row per scene and task. All combinations are scored, spread over tasks by their
    first scene: most tasks covered, largest least count, least deviation from the proportional target, most rows, least
    sum of scene numbers, then first in order."""
    ready(counts.sparkSession)
    rooms = counts.groupBy("room").agg(F.array_sort(F.collect_set("scene")).alias("scenes"), F.collect_list(F.struct("scene", "task", "n")).alias("counts"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                scenes = np.array(row.scenes, dtype=np.int64)
                tasks = sorted({c["task"] for c in row.counts})
                table = np.zeros((len(scenes), len(tasks)))
                for c in row.counts:
                    table[np.searchsorted(scenes, c["scene"]), tasks.index(c["task"])] += c["n"]
                found = _scored(table, scenes, row.first, max(1, round(len(scenes) * fraction)))
                if found:
                    out.append((row.room, *found))
            yield pd.DataFrame(out, columns=["room", "covered", "least", "off", "total", "ids", "scenes"])

    each = rooms.select("room", "scenes", "counts", F.explode(F.sequence(F.lit(0), F.size("scenes") - 1)).alias("first"))
    best = each.repartition("room", "first").mapInPandas(score, "room string, covered double, least double, off double, total double, ids long, scenes array<long>")
    return best.groupBy("room").agg(F.min(F.struct("covered", "least", "off", "total", "ids", "scenes"))["scenes"].alias("scenes"))


def clusters(scenes: DataFrame, names: list[str]) -> DataFrame:
    """scene, cluster, n: scenes (scene, room, n) in order of falling n, room and scene, each to the cluster with fewest rows, then fewest scenes, then first name."""
    placed, load = [], {name: [0, 0] for name in names}
    for row in scenes.select("scene", "room", "n").orderBy(F.desc("n"), "room", "scene").collect():  # an aggregate: a row per scene
        to = min(names, key=lambda name: (*load[name], name))
        load[to][0] += row.n
        load[to][1] += 1
        placed.append((row.scene, to, row.n))
    kind = scenes.schema["scene"].dataType.simpleString()
    return scenes.sparkSession.createDataFrame(placed, f"scene {kind}, cluster string, n long")


def with_cluster(rows: DataFrame, placed: DataFrame, names: list[str], scene: str, key: str) -> DataFrame:
    """Monitor rows with their cluster and monitor_only: that of their scene, if it has one.

    Other rows, in order of scene and key, go one by one to the cluster with fewest monitor rows, then the first name; rows
    of placed scenes are counted first. Which cluster the j-th row falls to follows from the clusters' counts alone."""
    known = placed.select(F.col("scene").alias("_scene"), F.col("cluster"))
    joined = rows.join(known, F.col(scene).eqNullSafe(F.col("_scene")), "left").drop("_scene")
    load = dict.fromkeys(names, 0) | {r.cluster: r["count"] for r in joined.filter("cluster is not null").groupBy("cluster").count().collect()}  # a row per cluster
    order = sorted(names, key=lambda name: (load[name], name))
    # phase i fills the i + 1 lowest clusters in turn, up to the height of the next
    phases, start = [], 0
    for i, name in enumerate(order):
        active = sorted(order[: i + 1])
        phases.append((start, active))
        start += len(active) * (load[order[i + 1]] - load[name]) if i + 1 < len(order) else 0
    turn = F.lit(None).cast("string")
    for begin, active in phases:
        in_turn = F.element_at(F.array(*map(F.lit, active)), ((F.col("_j") - begin) % len(active) + 1).cast("int"))
        turn = F.when(F.col("_j") >= begin, in_turn).otherwise(turn)
    loose = joined.filter("cluster is null").drop("cluster")
    return joined.filter("cluster is not null").withColumn("monitor_only", F.lit(False)).unionByName(numbered(loose, [scene, key], "_j").withColumn("cluster", turn).withColumn("monitor_only", F.lit(True)).drop("_j"))


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place (from 0) in a total order of columns."""
    return ranking.placed(rows, order, name)


def method_views(parts: DataFrame, part: str, cluster: str) -> DataFrame:
    """The rows of every view of a release with view and file: each row is read once and repeated for the views that hold it.

    parts has a column that is train, monitor or the name of an evaluation split, and one with the row's cluster. Train and
    monitor rows make up fine_tuning, adapter and the world model of their cluster, train rows the retrieval index too, and others evaluation."""
    is_train, in_pool = F.col(part) == "train", F.col(part).isin("train", "monitor")
    file = F.when(is_train, "train").otherwise("test")
    at = lambda when, view, name: F.when(when, F.struct(F.lit(view).alias("view") if isinstance(view, str) else view.alias("view"), name.alias("file")))
    held = [
        at(in_pool, "fine_tuning", file),
        at(in_pool, "adapter", file),
        at(is_train, "retrieval", F.lit("index")),
        at(in_pool, F.concat(F.lit("world_model/"), F.col(cluster)), file),
        at(~in_pool, F.concat(F.lit("eval/"), F.col(part)), F.lit("test")),
    ]
    out = rows_with = parts.withColumn("_at", F.explode(F.array_compact(F.array(*held))))
    return out.select("_at.view", "_at.file", *[c for c in rows_with.columns if c != "_at"])


def resplit_by_unseen_task(rows: DataFrame, room: str, task: str, key: str, seen_rooms: list[str], unseen_tasks: list[str], share: float, seed: int) -> DataFrame:
    """rows with file: of seen rooms, train and test (a share of the seen tasks' rows, one at least) and test_unseen_task;
    of other rooms every row in test, and those of unseen tasks in test_unseen_task as well."""
    new, known = F.col(task).isin(*unseen_tasks), F.col(room).isin(*seen_rooms)
    held = splits.holdout(rows.filter(known & ~new), [room], key, share, seed)
    carved = held.withColumn("file", F.when(F.col("held_out"), "test").otherwise("train")).drop("held_out")
    both = F.array_compact(F.array(F.when(~known, F.lit("test")), F.when(new, F.lit("test_unseen_task"))))
    return carved.unionByName(rows.filter(~known | new).withColumn("file", F.explode(both)))


def resplit_by_task_type(files: DataFrame, room: str, task: str, unseen_room: str, seen_tasks: list[str]) -> DataFrame:
    """Rows of resplit_by_unseen_task with target: the pool of their task (train and unseen-task rows of seen rooms) and the evaluation column they belong to."""
    away, old = F.col(room) == unseen_room, F.col(task).isin(*seen_tasks)
    file = F.col("file")
    held = F.array_compact(
        F.array(
            F.when(~away & file.isin("train", "test_unseen_task"), F.concat(F.lit("task_"), F.col(task))),
            F.when(~away & (file == "test"), F.lit("seen_task_seen_scene")),
            F.when(~away & (file == "test_unseen_task"), F.lit("unseen_task_seen_scene")),
            F.when(away & (file == "test") & old, F.lit("seen_task_unseen_scene")),
            F.when(away & (file == "test_unseen_task"), F.lit("unseen_task_unseen_scene")),
        )
    )
    return files.withColumn("target", F.explode(held))


def check_counts(rows: DataFrame, by: list[str], expected: dict[tuple, int]) -> None:
    """An error that names the groups whose counts are not as expected; groups that are not expected may be there."""
    found = {tuple(r[c] for c in by): r["count"] for r in rows.groupBy(*by).count().collect()}  # a row per file
    wrong = {k: (found.get(k, 0), n) for k, n in expected.items() if found.get(k, 0) != n}
    if wrong:
        raise ValueError("; ".join(f"{'/'.join(map(str, k))}: {have} rows, expected {n}" for k, (have, n) in sorted(wrong.items())))


def family_of(trajectory: Column) -> Column:
    """The family in `scene:family:args`; colons of the arguments stay where they are."""
    return F.get(F.split(trajectory, ":", 3), F.lit(1))


def evaluation_variants(steps: DataFrame, trajectory: str, split: str, per_family: int, seed: int) -> DataFrame:
    """Steps of seen_seen trajectories with variant: full, and balanced for the first per_family of each family in hashed order."""
    own = steps.filter(F.col(split) == "seen_seen")
    ids = own.select(trajectory).distinct().withColumn("_family", family_of(F.col(trajectory)))
    balanced = splits.sample_per_group(ids, ["_family"], trajectory, per_family, seed).select(F.col(trajectory).alias("_id"), F.lit(True).alias("_in"))
    marked = own.join(balanced, F.col(trajectory) == F.col("_id"), "left")
    return marked.withColumn("variant", F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col("_in"), F.lit("balanced")))))).drop("_id", "_in")


def expected_task_split(tasks: DataFrame, family: str, key: str, seen: int, seed: int) -> DataFrame:
    """tasks with task_split where no manifest tells it: `seen` tasks are shared among families in proportion, the first of each in hashed order."""
    counts = {r[family]: r["count"] for r in tasks.groupBy(family).count().collect()}  # a row per family
    quota = planning.quotas(counts, seen, sum(counts.values()))
    limit = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair]) if quota else F.create_map().cast("map<string,int>")
    place = F.row_number().over(Window.partitionBy(family).orderBy(seeded_order(seed, key), key))
    return tasks.withColumn("task_split", F.when(place <= F.try_element_at(limit, F.col(family)), "seen").otherwise("unseen"))
