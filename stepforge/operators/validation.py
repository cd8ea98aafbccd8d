"""Checks of step rows and trajectories that return a row per error, lookups that must succeed, and exact splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.stats import seeded_order
from stepforge.functions.text import action_words, goal, goal_visible, sentences, triple_texts, triples
from stepforge.operators import membership, splits

# Verbs of step rows, those of two objects, and the verb that each task family ends with.
ALLOWED, TWO_OBJECTS = ("walk", "grab", "open", "switchon", "put", "putin"), ("put", "putin")
LAST_VERB = {"turnon": "switchon", "open": "open", "puton": "put", "placein": "putin"}
# Families whose trajectories must hold a grab.
GRABBING = ("puton", "placein")
_TEXTS = ("instruction", "observation", "action", "next_observation")


def reported(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """keys, error: a row for each check that a row fails; a check that is null fails nothing."""
    failed = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))
    return rows.select(*keys, F.explode(failed).alias("error"))


def step_errors(steps: DataFrame, keys: list[str], expected_split: str | Column, scenes: DataFrame | None = None) -> DataFrame:
    """keys, error for step rows (instruction, observation, action, next_observation, _meta).

    A missing text or key of _meta, another split than expected, a scene that is not among scenes (scene), step numbers
    out of range, verbs that are not allowed, and a wrong number of objects. A row without _meta fails that check alone."""
    meta, words = F.col("_meta"), action_words(F.col("action"))
    verb, objects = F.get(words, F.lit(0)), F.size(words) - 1
    has = meta.isNotNull()
    checks = {f"no_{c}": F.col(c).isNull() for c in _TEXTS}
    checks["no_meta"] = meta.isNull()
    checks |= {f"no_meta_{c}": has & F.col(f"_meta.{c}").isNull() for c in ("scene", "split", "task_args", "step_index", "num_steps")}
    checks["split"] = F.col("_meta.split") != expected_split
    checks["step_range"] = (F.col("_meta.step_index") < 0) | (F.col("_meta.step_index") >= F.col("_meta.num_steps"))
    checks["task_args"] = F.exists("_meta.task_args", lambda x: x.isNull())
    checks["verb"] = F.coalesce(~verb.isin(*ALLOWED), F.col("action").isNotNull())
    checks["arity"] = verb.isin(*ALLOWED) & (objects != F.when(verb.isin(*TWO_OBJECTS), 2).otherwise(1))
    if scenes is not None:
        known = scenes.select(F.col("scene").alias("_scene"), F.lit(True).alias("_known")).distinct()
        steps = steps.join(known, F.col("_meta.scene") == F.col("_scene"), "left")
        checks["scene"] = F.col("_meta.scene").isNotNull() & F.col("_known").isNull()
    return reported(steps, keys, checks)


def trajectory_errors(steps: DataFrame, family: Column) -> DataFrame:
    """trajectory_id, error for step rows with _meta.

    Steps that do not number 0 to num_steps - 1, each once; of the others, mixed scenes or arguments, a last verb
    that is not the family's, no grab where the family needs one, a goal that the last observation does not show, and an
    observation that is not the one before said would come."""
    one = steps.select("_meta.trajectory_id", "_meta.step_index", "_meta.num_steps", "_meta.scene", "_meta.task_args", F.get(action_words(F.col("action")), F.lit(0)).alias("verb"), "observation", "next_observation", family.alias("family"))
    # in order of the steps; what is said to come next stands beside what came
    ordered = one.withColumn("_told", F.lag("next_observation").over(Window.partitionBy("trajectory_id").orderBy("step_index")))
    last = F.struct("verb", "next_observation", "family", "task_args")
    each = ordered.groupBy("trajectory_id").agg(
        F.count("*").alias("n"), F.count_distinct("step_index").alias("distinct"), F.min("step_index").alias("low"), F.max("step_index").alias("high"), F.min("num_steps").alias("least"), F.max("num_steps").alias("most"),
        F.count_distinct("scene").alias("scenes"), F.count_distinct("task_args").alias("args"), F.max_by(last, "step_index").alias("last"), F.coalesce(F.bool_or(F.col("verb") == "grab"), F.lit(False)).alias("grab"),
        F.coalesce(F.bool_or((F.col("step_index") > 0) & (F.col("_told") != F.col("observation"))), F.lit(False)).alias("unaligned"),
    )
    whole = (F.col("n") == F.col("most")) & (F.col("distinct") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("least") == F.col("most"))
    whole = F.coalesce(whole, F.lit(False))
    ends = F.create_map(*[F.lit(x) for pair in LAST_VERB.items() for x in pair])
    kind = F.col("last.family")
    checks = {
        "steps": ~whole,
        "mixed_scene": whole & (F.col("scenes") > 1),
        "mixed_args": whole & (F.col("args") > 1),
        "last_verb": whole & ~F.col("last.verb").eqNullSafe(F.try_element_at(ends, kind)),
        "no_grab": whole & kind.isin(*GRABBING) & ~F.col("grab"),
        "goal": whole & goal(kind, F.col("last.task_args")).isNotNull() & ~goal_visible(F.col("last.next_observation"), kind, F.col("last.task_args")),
        "unaligned": whole & F.col("unaligned"),
    }
    return reported(each, ["trajectory_id"], checks)


def episode_errors(episodes: DataFrame) -> DataFrame:
    """episode_id, error for episodes (task, trial_name, history, _meta): missing keys, an empty history, a history without any
    action, one whose last step is not done, and rewards that end below 1 though the expert succeeded."""
    last = F.try_element_at("history", F.lit(-1))
    filled = F.size("history") > 0
    checks = {
        "no_task": F.coalesce(F.col("task"), F.lit("")) == "",
        "no_trial": F.coalesce(F.col("trial_name"), F.lit("")) == "",
        "empty_history": ~F.coalesce(filled, F.lit(False)),
        "no_action": filled & ~F.exists("history", lambda h: F.coalesce(h["action"], F.lit("")) != ""),
        "not_done": filled & ~F.coalesce(last["dones"], F.lit(False)),
        "no_success": filled & F.col("_meta.expert_success") & (F.coalesce(last["reward"], F.lit(0.0)) < 1),
    }
    return reported(episodes.withColumn("episode_id", F.col("_meta.episode_id")), ["episode_id"], checks)


def semantically_valid(satisfied: Column, start: Column, end: Column, family: Column, args: Column) -> Column:
    """A trajectory whose goal holds and shows at its end, and does not show at its start."""
    return satisfied & goal_visible(end, family, args) & ~goal_visible(start, family, args)


def enriched(rows: DataFrame, dim: DataFrame, key: str, agree: Column | None = None, strict: bool = False) -> DataFrame:
    """rows with the fields of dim._meta put into their _meta, those of dim winning, and reason: ok, missing or mismatch.

    Only rows that are ok change. With strict, any other row is an error. dim (key, _meta) has each key once."""
    other = dim.select(F.col(key).alias("_key"), F.col("_meta").alias("_dim"))
    joined = rows.join(other, F.col(key) == F.col("_key"), "left")
    reason = F.when(F.col("_key").isNull(), "missing").when(~agree if agree is not None else F.lit(False), "mismatch").otherwise("ok")
    mine, theirs = (df.schema["_meta"].dataType for df in (rows, dim))
    ok = F.col("reason") == "ok"
    fields = [F.when(ok, F.col(f"_dim.{n}")).otherwise(F.col(f"_meta.{n}") if n in mine.names else F.lit(None)).alias(n) if n in theirs.names else F.col(f"_meta.{n}") for n in dict.fromkeys([*mine.names, *theirs.names])]
    out = joined.withColumn("reason", reason)
    if strict:
        told = F.concat(F.col("reason"), F.lit(" key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        out = out.withColumn("reason", F.when(ok, "ok").otherwise(F.raise_error(told)))
    return out.withColumn("_meta", F.struct(*fields)).drop("_key", "_dim")


def tagged(rows: DataFrame, field: str, value: str | Column) -> DataFrame:
    """A field of _meta set to a value in every row."""
    return rows.withColumn("_meta", F.col("_meta").withField(field, F.lit(value) if isinstance(value, str) else value))


def scene_split(rows: DataFrame, mode: str, unseen: list) -> DataFrame:
    """scene_split of _meta: unseen where the room type (mode room_type) or the scene number (scene_num) is among unseen."""
    if mode not in ("room_type", "scene_num"):
        raise ValueError(f"unknown mode: {mode}")
    return tagged(rows, "scene_split", F.when(F.col(f"_meta.{mode}").isin(*unseen), "unseen").otherwise("seen"))


def shuffled_take(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in a seeded order of keys; an error if there are fewer."""
    if (have := rows.count()) < n:
        raise ValueError(f"{n} rows asked of {have}")
    return rows.orderBy(seeded_order(seed, *keys), *keys).limit(n)


def exact_split(rows: DataFrame, held: int, seed: int, key: str, stratify: list[str] | None = None) -> DataFrame:
    """rows with held_out: true for exactly that many of them, the first in a seeded order of key; with stratify, each stratum gives its share."""
    return splits.exact_holdout(rows, stratify or [], key, held, seed)


def paired(left: Column, right: Column) -> Column:
    """Structs (left, right) of two arrays by place, as many as the shorter has."""
    n = F.least(F.size(left), F.size(right))
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= n, F.struct(F.get(left, i - 1).alias("left"), F.get(right, i - 1).alias("right"))))


def prototype_texts(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, text: the state texts that prototypes are made of, by what columns rows have.

    Step rows give the parts of both observations, episodes the sentences of every step's, and others every string."""
    none = F.array().cast("array<string>")
    if set(_TEXTS) <= set(rows.columns):
        parts = F.concat(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(triple_texts(F.col(c))) for c in ("observation", "next_observation")])
    elif "history" in rows.columns:
        parts = F.flatten(F.transform(F.coalesce("history", F.array()), lambda h: F.concat(sentences(h["observation"]), sentences(h["next_observation"]))))
    else:
        strings = [c for c, kind in rows.dtypes if kind == "string" and c != key]
        parts = F.array_compact(F.array(*[F.col(c) for c in strings])) if strings else none
    return rows.select(key, F.posexplode(parts).alias("pos", "text"))


def release_report(views: dict[str, DataFrame], key: str, disjoint: list[tuple[str, str]], nested: list[tuple[str, str]]) -> DataFrame:
    """view, error, n for the views of a release: keys that repeat in a view, that two disjoint views share, or that a nested view has and its outer one has not."""
    of = membership.Views(list(views))
    masks = of.masks(membership.union({name: rows.select(key) for name, rows in views.items()}, "_view"), {"id": F.col(key)}, "_view")
    some = F.col("n") > 0
    rules = [("repeated", name, "error", of.repeated("id", name), some) for name in views]
    rules += [(f"shared with {b}", a, "error", of.shared("id", [a], [b]), some) for a, b in disjoint]
    rules += [(f"not in {b}", a, "error", of.missing("id", [a], [b]), some) for a, b in nested]
    return membership.counted(masks, rules).filter("broken").select(F.col("subject").alias("view"), F.col("rule").alias("error"), "n")


def goal_satisfied(observation: Column, family: Column, args: Column) -> Column:
    """Whether a state, written as triples, holds the task's goal under any of its objects' states."""
    want = goal(family, args)
    return F.coalesce(F.exists(triples(observation), lambda t: (t["s"] == want["s"]) & (t["r"] == want["r"]) & (t["o"] == want["o"])), F.lit(False))
