"""Relations of views by masks against sets and counters."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepforge.operators import membership


def made(seed):
    rng = random.Random(seed)
    return [(rng.choice("abcd"), rng.choice((None, *range(12))), rng.choice("xyz")) for _ in range(120)]


@pytest.mark.parametrize("seed", range(3))
def test_relations(spark, seed):
    rows = made(seed)
    views = membership.Views(list("abc"))
    masks = views.masks(spark.createDataFrame(rows, "view string, id int, scene string"), {"id": F.col("id"), "scene": F.col("scene")})
    held = {v: Counter(i for w, i, _ in rows if w == v and i is not None) for v in "abc"}
    scenes = {v: {s for w, _, s in rows if w == v} for v in "abc"}
    found = masks.agg(
        views.rows("id", "a", "b"), views.distinct("id", "c"), views.repeated("id", "a"), views.shared("id", ["a"], ["b", "c"]), views.missing("id", ["a", "b"], ["c"]), views.unequal("id", ["a"], ["b"]), views.distinct("scene", "b", among=["x", "q"]),
    ).first()
    a, b, c = (set(held[v]) for v in "abc")
    assert tuple(found) == (
        held["a"].total() + held["b"].total(), len(c), sum(n > 1 for n in held["a"].values()), len(a & (b | c)), len((a | b) - c), sum(held["a"][i] != held["b"][i] for i in a | b), len(scenes["b"] & {"x", "q"}),
    )
    sides = {(r.key, r.side) for r in membership.key_difference(masks, views, "id", "a", "b").collect()}
    assert sides == {(str(i), "missing") for i in a - b} | {(str(i), "extra") for i in b - a}


def test_no_rows(spark):
    views = membership.Views(["a", "b"])
    none = views.masks(spark.createDataFrame([], "view string, id int"), {"id": F.col("id")})
    rules = [("empty", "a", "error", views.rows("id", "a"), F.col("n") == 0), ("same", "a", "error", views.unequal("id", ["a"], ["b"]), F.col("n") > 0)]
    assert [tuple(r) for r in membership.counted(none, rules).collect()] == [("empty", "a", "error", 0, True), ("same", "a", "error", 0, False)]


def test_names():
    with pytest.raises(ValueError, match="at most 63"):
        membership.Views([str(i) for i in range(64)])
    with pytest.raises(ValueError, match="different names"):
        membership.Views(["a", "a"])


def test_one_shuffle(spark):
    """All rules over all views take one exchange for the masks and one for the counts."""
    views = membership.Views(["a", "b", "c"])
    masks = views.masks(spark.createDataFrame(made(0), "view string, id int, scene string"), {"id": F.col("id"), "scene": F.col("scene")})
    rules = [(f"{x}{y}", x, "error", views.shared("id", [x], [y]), F.col("n") > 0) for x in "abc" for y in "abc"]
    plan = membership.counted(masks, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 2


def test_release_without_faults(spark):
    evals, clusters = ["e1", "e2", "e3"], ["c0", "c1"]
    names = ["canonical", "canonical/empty_history", "canonical/not_done", "train", "monitor", *evals, "fine_tuning/train", "fine_tuning/test", "adapter/train", "adapter/test", "retrieval/index", *[f"world_model/{c}/{f}" for c in clusters for f in ("train", "test")], *[f"{k}/{e}" for e in evals for k in ("eval", "compat")]]
    views = membership.Views(names)
    rows = []
    for i in range(40):
        split = ("train", "train", "monitor", *evals)[i % 6]
        task = "new" if split == "e3" else ("old", "other")[i // 6 % 2]
        files = {"train": ["fine_tuning/train", "adapter/train", "retrieval/index", f"world_model/c{i // 6 % 2}/train"], "monitor": ["fine_tuning/test", "adapter/test", f"world_model/c{i // 6 % 2}/test"]}.get(split, [f"eval/{split}", f"compat/{split}"])
        rows += [(v, f"e{i}", f"t{i}", "away" if split in evals[1:] else "home", task) for v in ("canonical", split, *files)]
    frame = spark.createDataFrame(rows, "view string, episode string, trial string, scene string, task string")
    masks = views.masks(frame, {c: F.col(c) for c in ("episode", "trial", "scene", "task")})
    sizes = {c: tuple(sum(r[0] == f"world_model/{c}/{f}" for r in rows) for f in ("train", "test")) for c in clusters}
    rules = membership.release_rules(views, evals, evals[1:], ["new"], clusters) + membership.view_rules(views, evals, sizes)
    found = membership.counted(masks, rules).collect()
    assert not [r for r in found if r.broken] and len(found) == len(rules)
    less = views.masks(frame.filter("not (view = 'adapter/train' and episode = 'e0')"), {c: F.col(c) for c in ("episode", "trial", "scene", "task")})
    assert {(r.rule, r.subject, r.n) for r in membership.counted(less, rules).collect() if r.broken} == {("method_count", "adapter", -1), ("view_differs", "adapter/train", 1)}
