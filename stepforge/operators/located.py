"""A release of step rows checked in one scan: errors with their file and line, and statistics observed on the way.

Rows come as variants (sources.lines.variants), so a row with a key of the wrong type, or none, is a row with an error and
not a failed read. A row that lacks what later checks need is not checked further and takes no part in its trajectory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stepforge.functions.text import action_words, goal, goal_visible, task_family, triples
from stepforge.operators import membership
from stepforge.operators.validation import ALLOWED, GRABBING, LAST_VERB, TWO_OBJECTS, reported
from stepforge.sources.lines import has, text_of

# Keys of _meta that must be there, and the verbs of a trajectory of each family in the simple mode.
META_KEYS = ("scene", "split", "task_args", "trajectory_id", "step_index", "num_steps")
SEQUENCES = {"turnon": ["walk", "switchon"], "open": ["walk", "open"], "puton": ["walk", "grab", "walk", "put"], "placein": ["walk", "grab", "walk", "open", "putin"]}
_TEXTS = ("instruction", "observation", "action", "next_observation")


def _kind(row: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.variant_get(row, f"$.{path}", "variant")), F.lit("VOID"))


def checked(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """path, line, role, split, errors, usable and the fields of rows (path, line, row, role, split), against the scenes (scene) that there are.

    Errors: no_json, no_<key>, <text>_type, meta_type, no_meta_<key>, split, scene, task_args, step_type, step_range, instruction, verb, arity."""
    row = F.col("row")
    known = scenes.select(F.col("scene").alias("_scene"), F.lit(True).alias("_known")).distinct()
    # what is read of the variants stands in columns of its own, which the checks then share
    here = {f"_has_{k}": has(row, k) for k in (*_TEXTS, "_meta")} | {f"_has_meta_{k}": has(row, f"_meta.{k}") for k in META_KEYS}
    kinds = {f"_kind_{k}": _kind(row, k) for k in (*_TEXTS, "_meta")} | {f"_kind_meta_{k}": _kind(row, f"_meta.{k}") for k in ("task_args", "step_index", "num_steps")}
    texts = {k: text_of(row, k) for k in _TEXTS} | {k: text_of(row, f"_meta.{k}") for k in ("scene", "trajectory_id")} | {"_split": text_of(row, "_meta.split")}
    numbers = {k: text_of(row, f"_meta.{k}").try_cast("int") for k in ("step_index", "num_steps")}
    args = {"task_args": F.try_variant_get(row, "$._meta.task_args", "array<string>")}
    each = rows.select("path", "line", "role", "split", row.isNotNull().alias("_parsed"), *[c.alias(name) for name, c in (here | kinds | texts | numbers | args).items()])
    each = each.join(known, F.col("scene") == F.col("_scene"), "left")
    each = each.withColumns({"family": F.when(F.col("_kind_instruction") == "STRING", task_family(F.col("instruction"))), "_words": action_words(F.col("action"))})
    all_of = lambda names: reduce(Column.__and__, [F.col(n) for n in names])
    each = each.withColumn("_whole", F.col("_parsed") & all_of(f"_has_{k}" for k in (*_TEXTS, "_meta")))
    each = each.withColumn("_full", F.col("_whole") & F.col("_kind__meta").startswith("OBJECT") & all_of(f"_has_meta_{k}" for k in META_KEYS))
    each = each.withColumns({"usable": F.coalesce(F.col("_full") & F.col("family").isNotNull(), F.lit(False)), "verb": F.coalesce(F.get("_words", F.lit(0)), F.lit("")), "_objects": F.size("_words") - 1})
    parsed, whole, full, usable, verb = (F.col(c) for c in ("_parsed", "_whole", "_full", "usable", "verb"))
    meta, told = F.col("_kind__meta").startswith("OBJECT"), F.col("_kind_instruction") == "STRING"
    whole_numbers = (F.col("_kind_meta_step_index") == "BIGINT") & (F.col("_kind_meta_num_steps") == "BIGINT")
    checks = {"no_json": ~parsed}
    checks |= {f"no_{k}": parsed & ~F.col(f"_has_{k}") for k in (*_TEXTS, "_meta")}
    checks |= {f"{k}_type": whole & (F.col(f"_kind_{k}") != "STRING") for k in _TEXTS}
    checks["meta_type"] = whole & ~meta
    checks |= {f"no_meta_{k}": whole & meta & ~F.col(f"_has_meta_{k}") for k in META_KEYS}
    checks["split"] = full & ~F.col("_split").eqNullSafe(F.col("split"))
    checks["scene"] = full & F.col("_known").isNull()
    checks["task_args"] = full & ~F.col("_kind_meta_task_args").isin("ARRAY<STRING>", "ARRAY<VOID>")
    checks["step_type"] = full & ~whole_numbers
    checks["step_range"] = full & whole_numbers & ((F.col("step_index") < 0) | (F.col("step_index") >= F.col("num_steps")))
    checks["instruction"] = full & told & F.col("family").isNull()
    checks["verb"] = usable & ~verb.isin(*ALLOWED)
    checks["arity"] = usable & verb.isin(*ALLOWED) & (F.col("_objects") != F.when(verb.isin(*TWO_OBJECTS), 2).otherwise(1))
    errors = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))
    return each.select("path", "line", "role", "split", errors.alias("errors"), "usable", *_TEXTS, "scene", "task_args", "trajectory_id", "step_index", "num_steps", "family", "verb")


def statistics() -> dict[str, Column]:
    """What is observed on rows of `checked`: rows, usable ones, families, verbs, steps that change nothing by verb, and `is` triples."""
    usable = F.col("usable")
    of_is = F.size(F.filter(triples(F.col("observation")), lambda t: t["r"] == "is"))
    out = {"rows": F.count(F.lit(1)), "usable": F.count_if(usable), "with_errors": F.count_if(F.size("errors") > 0)}
    out |= {f"family_{f}": F.count_if(usable & (F.col("family") == f)) for f in SEQUENCES}
    for name, own in [(v, F.col("verb") == v) for v in ALLOWED] + [("other", ~F.col("verb").isin(*ALLOWED))]:
        out[f"verb_{name}"] = F.count_if(usable & own)
        out[f"unchanged_{name}"] = F.count_if(usable & own & (F.col("observation") == F.col("next_observation")))
    out["is_triples"] = F.coalesce(F.sum(F.when(usable, of_is)), F.lit(0)).cast("long")
    return out


def observed(rows: DataFrame, seen: Observation) -> DataFrame:
    """rows of `checked`, their statistics observed by the same scan that delivers them."""
    return rows.observe(seen, *[c.alias(name) for name, c in statistics().items()])


def row_errors(rows: DataFrame) -> DataFrame:
    return rows.select("path", "line", F.explode("errors").alias("error"))


def trajectories(rows: DataFrame) -> DataFrame:
    """trajectory_id with its roles, family, scene, args and its steps in order, of the usable rows of `checked`."""
    step = F.struct("step_index", "path", "line", "num_steps", "scene", "task_args", "family", "verb", "action", "next_observation")
    own = rows.filter("usable").groupBy("trajectory_id").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.sort_array(F.collect_set("role")).alias("roles"))
    first = F.col("steps")[0]
    return own.select("trajectory_id", "roles", "steps", first["num_steps"].alias("num_steps"), first["scene"].alias("scene"), first["task_args"].alias("task_args"), first["family"].alias("family"))


def trajectory_errors(of: DataFrame, simple: bool) -> DataFrame:
    """trajectory_id, error: roles (in train and test), steps (not numbered 0 to num_steps - 1); of whole ones mixed_scene, mixed_args, and with simple
    verbs (another sequence than the family's), else last_verb and no_grab."""
    steps, n = F.col("steps"), F.col("num_steps")
    numbers = F.transform(steps, lambda s: s["step_index"])
    whole = F.coalesce((n > 0) & (numbers == F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)), F.lit(False))
    verbs = F.transform(steps, lambda s: s["verb"])
    family = F.col("family")
    expected = F.create_map(*[x for f, v in SEQUENCES.items() for x in (F.lit(f), F.array(*map(F.lit, v)))])
    last = F.create_map(*[F.lit(x) for pair in LAST_VERB.items() for x in pair])
    checks = {
        "roles": F.size("roles") > 1,
        "steps": ~whole,
        "mixed_scene": whole & F.exists(steps, lambda s: ~s["scene"].eqNullSafe(F.col("scene"))),
        "mixed_args": whole & F.exists(steps, lambda s: ~s["task_args"].eqNullSafe(F.col("task_args"))),
    }
    if simple:
        checks["verbs"] = whole & (verbs != F.try_element_at(expected, family))
    else:
        checks["last_verb"] = whole & (F.element_at(verbs, -1) != F.try_element_at(last, family))
        checks["no_grab"] = whole & family.isin(*GRABBING) & ~F.array_contains(verbs, "grab")
    return reported(of, ["trajectory_id"], checks)


def goals_shown(of: DataFrame) -> DataFrame:
    """family, visible, hidden: whole trajectories whose last observation shows the goal or does not."""
    steps, n = F.col("steps"), F.col("num_steps")
    whole = F.transform(steps, lambda s: s["step_index"]) == F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    has_goal = goal(F.col("family"), F.col("task_args")).isNotNull()
    shown = goal_visible(F.element_at(steps, -1)["next_observation"], F.col("family"), F.col("task_args"))
    return of.filter(whole & has_goal).groupBy("family").agg(F.count_if(shown).alias("visible"), F.count_if(~shown).alias("hidden"))


def overlaps(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rule, subject, severity, n, broken: rows and sequences of actions that train and test share, and tasks that seen and unseen splits share, from one table of masks."""
    views = membership.Views(["train", "test", "seen", "unseen"])
    usable = rows.filter("usable")
    task = F.to_json(F.struct("family", "task_args"))
    text = F.sha2(F.to_json(F.struct(*_TEXTS)), 256)
    kinds = ["row", "task", "sequence", "task_sequence"]
    null = F.lit(None).cast("string")
    own = usable.select(F.col("role").alias("view"), text.alias("row"), null.alias("task"), null.alias("sequence"), null.alias("task_sequence"))
    tasks = usable.select(F.regexp_extract("split", "^(seen|unseen)_", 1).alias("view"), null.alias("row"), task.alias("task"), null.alias("sequence"), null.alias("task_sequence"))
    sequence = F.to_json(F.transform("steps", lambda s: s["action"]))
    both = of.select(F.explode("roles").alias("view"), null.alias("row"), null.alias("task"), sequence.alias("sequence"), F.concat(task, sequence).alias("task_sequence"))
    masks = views.masks(own.unionByName(tasks).unionByName(both), {k: F.col(k) for k in kinds})
    some = F.col("n") > 0
    rules = [("row_overlap", "train/test", "error", views.shared("row", ["train"], ["test"]), some), ("task_overlap", "seen/unseen", "error", views.shared("task", ["seen"], ["unseen"]), some)]
    rules += [(f"{k}_overlap", "train/test", "note", views.shared(k, ["train"], ["test"]), some) for k in ("sequence", "task_sequence")]
    return membership.counted(masks, rules)
