"""Which views hold which keys: one table of masks, from which every relation between views follows.

A view is a named set of rows: a split, a file of a method, rows with a defect. A row says, for each kind of key that it has (its
id, its trial, its scene), that its view holds that key. One groupBy(kind, key) makes of this a bit for each view and a
count for each view; partial counts before the shuffle keep keys that many rows have cheap. Overlaps, nesting, repeats,
differences of sets and of multisets, row counts and distinct counts of any views are then counted together in one pass over the masks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a mask.
MOST_VIEWS = 63


def union(parts: dict[str, DataFrame], view: str = "view") -> DataFrame:
    """The rows of all parts, which have the same columns, with the name of their part."""
    return reduce(DataFrame.unionByName, [rows.withColumn(view, F.lit(name)) for name, rows in parts.items()])


class Views:
    """Named views and the columns, over their masks, that tell how they relate."""

    def __init__(self, names: list[str]) -> None:
        if len(names) > MOST_VIEWS or len(set(names)) != len(names):
            raise ValueError(f"{len(names)} views: at most {MOST_VIEWS} of different names fit a mask")
        self.place = {name: i for i, name in enumerate(names)}

    def masks(self, rows: DataFrame, keys: dict[str, Column], view: str = "view") -> DataFrame:
        """kind, key, mask, counts: for each kind of key its values as text, without nulls; rows of other views are left out."""
        at = F.array_position(F.array(*[F.lit(n) for n in self.place]), F.col(view)) - 1
        held = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in keys.items()]))
        each = rows.select(at.cast("int").alias("at"), held.alias("of")).filter("at >= 0 and of.key is not null").select("at", "of.kind", "of.key")
        counts = [F.count_if(F.col("at") == i).alias(f"n{i}") for i in self.place.values()]
        own = each.groupBy("kind", "key").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"), *counts)
        return own.select("kind", "key", "mask", F.array(*[f"n{i}" for i in self.place.values()]).alias("counts"))

    def bits(self, *views: str) -> int:
        return sum(1 << self.place[v] for v in views)

    def held(self, *views: str) -> Column:
        """Whether one of the views holds the key."""
        return F.col("mask").bitwiseAND(F.lit(self.bits(*views))) != 0

    def total(self, *views: str) -> Column:
        """Rows with the key in all of the views together."""
        return reduce(Column.__add__, [F.get("counts", F.lit(self.place[v])) for v in views], F.lit(0).cast("long"))

    # counts over the masks
    def rows(self, kind: str, *views: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, self.total(*views))), F.lit(0).cast("long"))

    def distinct(self, kind: str, *views: str, among: list[str] | None = None) -> Column:
        """Keys that one of the views holds, of those among if given."""
        some = F.col("key").isin(*among) if among is not None else F.lit(True)
        return F.count_if((F.col("kind") == kind) & some & self.held(*views))

    def repeated(self, kind: str, view: str) -> Column:
        return F.count_if((F.col("kind") == kind) & (self.total(view) > 1))

    def shared(self, kind: str, left: list[str], right: list[str]) -> Column:
        return F.count_if((F.col("kind") == kind) & self.held(*left) & self.held(*right))

    def missing(self, kind: str, inner: list[str], outer: list[str]) -> Column:
        """Keys of the inner views that no outer one holds."""
        return F.count_if((F.col("kind") == kind) & self.held(*inner) & ~self.held(*outer))

    def unequal(self, kind: str, left: list[str], right: list[str]) -> Column:
        """Keys that both sides do not hold equally often: 0 if they are the same multiset."""
        return F.count_if((F.col("kind") == kind) & (self.total(*left) != self.total(*right)))


Rule = tuple[str, str, str, Column, Column]


def counted(masks: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, subject, severity, n, broken for rules (rule, subject, severity, count over the masks, broken by n), all counted in one pass.

    A rule's last column is a condition on n."""
    found = masks.agg(*[n.cast("long").alias(f"r{i}") for i, (_, _, _, n, _) in enumerate(rules)])
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), F.lit(severity).alias("severity"), F.col(f"r{i}").alias("n")) for i, (rule, subject, severity, _, _) in enumerate(rules)]))
    broken = reduce(lambda other, i: F.when(F.col("at") == i, rules[i][4]).otherwise(other), range(len(rules)), F.lit(None).cast("boolean"))
    return found.select(each).withColumn("broken", F.coalesce(broken, F.lit(False))).drop("at")


def release_rules(views: Views, evals: list[str], unseen_scenes: list[str], unseen_tasks: list[str], clusters: list[str]) -> list[Rule]:
    """The rules of a release over its masks of kinds episode, trial, scene and task.

    Views: canonical with its defects canonical/empty_history and canonical/not_done, train, monitor, the evaluation splits (evals; those of unseen_scenes
    must not share scenes with train, the last one must hold every unseen task, the first of them two tasks at least), fine_tuning/train,
    adapter/train, retrieval/index, and world_model/<cluster>/train and /test.
    Errors: repeated trials, empty histories, histories that do not end done, empty splits, episodes and trials of
    train and episodes of monitor in evaluation, scenes and unseen tasks that leak, unseen tasks without evaluation, methods that do not see as many
    episodes as train has, clusters without training rows. Warnings: too few tasks, clusters without monitor rows."""
    n = F.col("n")
    some, none = n > 0, n == 0
    worlds = [f"world_model/{c}/train" for c in clusters]
    train = views.rows("episode", "train")
    rules: list[Rule] = [
        ("repeated_trials", "canonical", "error", views.repeated("trial", "canonical"), some),
        ("empty_history", "canonical", "error", views.rows("episode", "canonical/empty_history"), some),
        ("not_done", "canonical", "error", views.rows("episode", "canonical/not_done"), some),
        *[("empty_split", v, "error", views.rows("episode", v), none) for v in ("train", "monitor", *evals)],
        ("episode_overlap", "train", "error", views.shared("episode", ["train"], evals), some),
        ("episode_overlap", "monitor", "error", views.shared("episode", ["monitor"], evals), some),
        ("trial_overlap", "train", "error", views.shared("trial", ["train"], evals), some),
        ("scene_overlap", "train", "error", views.shared("scene", ["train"], unseen_scenes), some),
        ("unseen_task_rows", "train", "error", _rows_among(views, "task", "train", unseen_tasks), some),
        *[("unseen_task_missing", t, "error", views.distinct("task", unseen_scenes[-1], among=[t]), none) for t in unseen_tasks],
        ("few_tasks", unseen_scenes[0], "warning", views.distinct("task", unseen_scenes[0]), n < 2),
        *[("method_count", name, "error", views.rows("episode", *of) - train, n != 0) for name, of in (("fine_tuning", ["fine_tuning/train"]), ("retrieval", ["retrieval/index"]), ("adapter", ["adapter/train"]), ("world_model", worlds))],
        *[("cluster_without_train", c, "error", views.rows("episode", f"world_model/{c}/train"), none) for c in clusters],
        *[("cluster_without_monitor", c, "warning", views.rows("episode", f"world_model/{c}/test"), none) for c in clusters],
    ]
    return rules


def _rows_among(views: Views, kind: str, view: str, among: list[str]) -> Column:
    of = (F.col("kind") == kind) & F.col("key").isin(*among)
    return F.coalesce(F.sum(F.when(of, views.total(view))), F.lit(0).cast("long"))


def view_rules(views: Views, evals: list[str], manifest: dict[str, tuple[int, int]]) -> list[Rule]:
    """Whether the files of a release hold the splits that they are made of, as multisets of episodes, and clusters the rows that the manifest states.

    Views: as in release_rules, with fine_tuning/test, adapter/test, and for each evaluation split eval/<split> and compat/<split>. manifest: train and monitor rows by cluster."""
    n = F.col("n")
    pairs = [(f"{m}/{f}", [f"{m}/{f}"], s) for m in ("fine_tuning", "adapter") for f, s in (("train", "train"), ("test", "monitor"))]
    pairs += [("retrieval/index", ["retrieval/index"], "train"), *[(f"{k}/{e}", [f"{k}/{e}"], e) for e in evals for k in ("eval", "compat")]]
    pairs += [(f"world_model/{f}", [f"world_model/{c}/{f}" for c in manifest], s) for f, s in (("train", "train"), ("test", "monitor"))]
    rules: list[Rule] = [("view_differs", name, "error", views.unequal("episode", held, [split]), n > 0) for name, held, split in pairs]
    for cluster, sizes in manifest.items():
        for file, size in zip(("train", "test"), sizes, strict=True):
            have = views.rows("episode", f"world_model/{cluster}/{file}")
            rules += [("manifest_differs", f"{cluster}/{file}", "error", have - F.lit(size), n != 0), ("no_rows", f"{cluster}/{file}", "error" if file == "train" else "warning", have, n == 0)]
    return rules


def key_difference(masks: DataFrame, views: Views, kind: str, left: str, right: str) -> DataFrame:
    """key, side for keys that one of two views alone holds: only in left (missing) or only in right (extra)."""
    alone = masks.filter(F.col("kind") == kind).filter(views.held(left) != views.held(right))
    return alone.select("key", F.when(views.held(left), "missing").otherwise("extra").alias("side"))
