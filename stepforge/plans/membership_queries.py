"""Queries of releases by membership masks: all rules of a release, views against splits, cluster keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators import membership
from stepforge.plans.registry import query, table

_EVALS = ["seen_seen", "seen_unseen", "unseen_unseen"]
_CLUSTERS = ["c0", "c1", "c2", "c3"]
_UNSEEN = ["4-NOT SPECIFIED", "5-LOW", "6-NEVER"]
_METHODS = [f"{m}/{f}" for m in ("fine_tuning", "adapter") for f in ("train", "test")] + ["retrieval/index"]
_NAMES = ["canonical", "canonical/empty_history", "canonical/not_done", "train", "monitor", *_EVALS, *_METHODS, *[f"{k}/{e}" for e in _EVALS for k in ("eval", "compat")], *[f"world_model/{c}/{f}" for c in _CLUSTERS for f in ("train", "test")]]
_MANIFEST = {"c0": (2, 1), "c1": (0, 0), "c2": (1, 2), "c3": (0, 0)}

#: Orders as episodes: lines are their steps; some splits leak, some files lack rows or hold them twice.
_VIEWS = """
    e AS (
        SELECT o_orderkey AS k, 'e' || o_orderkey AS episode, 't' || CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey // 100 ELSE o_orderkey END AS trial,
               's' || CASE WHEN o_orderkey % 20 >= 15 THEN o_custkey % 40 ELSE o_custkey % 30 END AS scene, o_orderpriority AS task,
               CASE WHEN o_orderkey % 20 < 11 THEN 'train' WHEN o_orderkey % 20 < 13 THEN 'monitor' WHEN o_orderkey % 20 < 15 THEN 'seen_seen' WHEN o_orderkey % 20 < 17 THEN 'seen_unseen' WHEN o_orderkey % 20 < 19 THEN 'unseen_unseen' END AS split,
               'c' || o_custkey % 3 AS cluster, steps, done
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS steps, max(2 * l_linenumber + (l_linestatus = 'F')::INT) % 2 = 1 AS done FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    ), v AS (
        SELECT 'canonical' AS "view", * FROM e
        UNION ALL SELECT 'canonical/empty_history', * FROM e WHERE steps IS NULL
        UNION ALL SELECT 'canonical/not_done', * FROM e WHERE NOT done
        UNION ALL SELECT split, * FROM e WHERE split IS NOT NULL
        UNION ALL SELECT 'seen_seen', * FROM e WHERE k % 211 = 0
        UNION ALL SELECT 'monitor', * FROM e WHERE k % 223 = 0
        UNION ALL SELECT 'fine_tuning/train', * FROM e WHERE split = 'train' AND k % 17 <> 3
        UNION ALL SELECT 'fine_tuning/test', * FROM e WHERE split = 'monitor' OR k % 223 = 0
        UNION ALL SELECT 'adapter/train', * FROM e WHERE split = 'train'
        UNION ALL SELECT 'adapter/test', * FROM e WHERE split = 'monitor'
        UNION ALL SELECT 'retrieval/index', * FROM e WHERE split = 'train'
        UNION ALL SELECT 'retrieval/index', * FROM e WHERE split = 'train' AND k % 301 = 0
        UNION ALL SELECT 'eval/' || split, * FROM e WHERE split LIKE '%een'
        UNION ALL SELECT 'compat/' || split, * FROM e WHERE split LIKE '%een' AND k % 400 <> 14
        UNION ALL SELECT 'world_model/' || cluster || '/train', * FROM e WHERE split = 'train' AND k % 100 <> 1
        UNION ALL SELECT 'world_model/' || cluster || '/test', * FROM e WHERE split = 'monitor' AND cluster <> 'c1'
    )
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, episode, trial, scene, task: an order once for every view that holds it."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.max(2 * F.col("l_linenumber") + (F.col("l_linestatus") == "F").cast("int")) % 2 == 1).alias("done"), F.count("*").alias("steps"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k").join(lines, "k", "left")
    k, cust = F.col("k"), F.col("o_custkey")
    split = F.expr("case when k % 20 < 11 then 'train' when k % 20 < 13 then 'monitor' when k % 20 < 15 then 'seen_seen' when k % 20 < 17 then 'seen_unseen' when k % 20 < 19 then 'unseen_unseen' end")
    rows = o.select(
        "k", F.concat(F.lit("e"), k.cast("string")).alias("episode"), F.concat(F.lit("t"), F.when(k % 50 == 0, F.expr("k div 100")).otherwise(k).cast("string")).alias("trial"),
        F.concat(F.lit("s"), F.when(k % 20 >= 15, cust % 40).otherwise(cust % 30).cast("string")).alias("scene"), F.col("o_orderpriority").alias("task"), split.alias("split"), F.concat(F.lit("c"), (cust % 3).cast("string")).alias("cluster"), "steps", "done",
    )
    held = {
        "canonical": "true", "canonical/empty_history": "steps is null", "canonical/not_done": "not done", "fine_tuning/train": "split = 'train' and k % 17 <> 3", "fine_tuning/test": "split = 'monitor' or k % 223 = 0",
        "adapter/train": "split = 'train'", "adapter/test": "split = 'monitor'", "retrieval/index": "split = 'train'",
    }
    more = [("seen_seen", "k % 211 = 0"), ("monitor", "k % 223 = 0"), ("retrieval/index", "split = 'train' and k % 301 = 0")]
    named = [F.when(F.expr(rule), F.lit(name)) for name, rule in [*held.items(), *more]]
    named += [F.col("split"), F.expr("case when split like '%een' then 'eval/' || split end"), F.expr("case when split like '%een' and k % 400 <> 14 then 'compat/' || split end")]
    named += [F.expr("case when split = 'train' and k % 100 <> 1 then 'world_model/' || cluster || '/train' end"), F.expr("case when split = 'monitor' and cluster <> 'c1' then 'world_model/' || cluster || '/test' end")]
    return rows.select(F.explode(F.array_compact(F.array(*named))).alias("view"), "episode", "trial", "scene", "task")


def _masks(spark: SparkSession, sf_dir: str) -> tuple[membership.Views, DataFrame]:
    views = membership.Views(_NAMES)
    return views, views.masks(_rows(spark, sf_dir), {c: F.col(c) for c in ("episode", "trial", "scene", "task")})


_LIST = ", ".join(f"'{e}'" for e in _EVALS)


def _shared(key: str, left: str, right: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM v WHERE \"view\" = '{left}' INTERSECT SELECT {key} FROM v WHERE \"view\" IN ({right})))"


def _size(view: str) -> str:
    return f"(SELECT count(*) FROM v WHERE \"view\" {view})"


def _rules_sql() -> str:
    train = _size("= 'train'")
    rules = [
        ("repeated_trials", "canonical", "error", "(SELECT count(*) FROM (SELECT trial FROM v WHERE \"view\" = 'canonical' GROUP BY trial HAVING count(*) > 1))", "n > 0"),
        ("empty_history", "canonical", "error", "(SELECT count(*) FROM e WHERE steps IS NULL)", "n > 0"),
        ("not_done", "canonical", "error", "(SELECT count(*) FROM e WHERE NOT done)", "n > 0"),
        *[("empty_split", s, "error", _size(f"= '{s}'"), "n = 0") for s in ("train", "monitor", *_EVALS)],
        ("episode_overlap", "train", "error", _shared("episode", "train", _LIST), "n > 0"),
        ("episode_overlap", "monitor", "error", _shared("episode", "monitor", _LIST), "n > 0"),
        ("trial_overlap", "train", "error", _shared("trial", "train", _LIST), "n > 0"),
        ("scene_overlap", "train", "error", _shared("scene", "train", "'seen_unseen', 'unseen_unseen'"), "n > 0"),
        ("unseen_task_rows", "train", "error", "(SELECT count(*) FROM v WHERE \"view\" = 'train' AND task IN ('4-NOT SPECIFIED', '5-LOW', '6-NEVER'))", "n > 0"),
        *[("unseen_task_missing", t, "error", f"(SELECT count(DISTINCT task) FROM v WHERE \"view\" = 'unseen_unseen' AND task = '{t}')", "n = 0") for t in _UNSEEN],
        ("few_tasks", "seen_unseen", "warning", "(SELECT count(DISTINCT task) FROM v WHERE \"view\" = 'seen_unseen')", "n < 2"),
        *[("method_count", m, "error", f"({_size(of)} - {train})", "n <> 0") for m, of in (("fine_tuning", "= 'fine_tuning/train'"), ("retrieval", "= 'retrieval/index'"), ("adapter", "= 'adapter/train'"), ("world_model", "LIKE 'world_model/%/train'"))],
        *[("cluster_without_train", c, "error", _size(f"= 'world_model/{c}/train'"), "n = 0") for c in _CLUSTERS],
        *[("cluster_without_monitor", c, "warning", _size(f"= 'world_model/{c}/test'"), "n = 0") for c in _CLUSTERS],
    ]
    each = " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{subject}' AS subject, '{severity}' AS severity, {n} AS n, {broken.replace('n ', n + ' ', 1)} AS broken" for rule, subject, severity, n, broken in rules)
    return f"WITH {_VIEWS} {each}"


@query(_rules_sql())
def release_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a release with what it counts and whether it is broken, from one table of masks."""
    views, masks = _masks(spark, sf_dir)
    return membership.counted(masks, membership.release_rules(views, _EVALS, _EVALS[1:], _UNSEEN, _CLUSTERS))


def _differs(held: str, split: str) -> str:
    return f"(SELECT count(*) FROM (SELECT episode, count(*) FILTER (\"view\" {held}) AS a, count(*) FILTER (\"view\" = '{split}') AS b FROM v GROUP BY episode) WHERE a <> b)"


def _views_sql() -> str:
    pairs = [("fine_tuning/train", "train"), ("fine_tuning/test", "monitor"), ("adapter/train", "train"), ("adapter/test", "monitor"), ("retrieval/index", "train"), *[(f"{k}/{e}", e) for e in _EVALS for k in ("eval", "compat")]]
    rules = [("view_differs", a, "error", _differs(f"= '{a}'", b), "> 0") for a, b in pairs]
    rules += [("view_differs", f"world_model/{f}", "error", _differs(f"LIKE 'world_model/%/{f}'", s), "> 0") for f, s in (("train", "train"), ("test", "monitor"))]
    for c, sizes in _MANIFEST.items():
        for f, size in zip(("train", "test"), sizes, strict=True):
            have = _size(f"= 'world_model/{c}/{f}'")
            rules += [("manifest_differs", f"{c}/{f}", "error", f"({have} - {size})", "<> 0"), ("no_rows", f"{c}/{f}", "error" if f == "train" else "warning", have, "= 0")]
    each = " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{subject}' AS subject, '{severity}' AS severity, {n} AS n, {n} {broken} AS broken" for rule, subject, severity, n, broken in rules)
    return f"WITH {_VIEWS} {each}"


@query(_views_sql())
def view_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a release against the split it is made of, as multisets, and against its manifest."""
    views, masks = _masks(spark, sf_dir)
    return membership.counted(masks, membership.view_rules(views, _EVALS, _MANIFEST))


@query(f"WITH {_VIEWS} SELECT rule, n FROM (SELECT 'errors' AS rule, count(*) AS n FROM ({_rules_sql()}) WHERE severity = 'error' AND broken UNION ALL SELECT 'warnings', count(*) FROM ({_rules_sql()}) WHERE severity = 'warning' AND broken)")
def release_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many errors and warnings a release has; without errors it is valid."""
    found = release_rule_table(spark, sf_dir).agg(*[F.count_if((F.col("severity") == s) & F.col("broken")).alias(f"{s}s") for s in ("error", "warning")])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in ("errors", "warnings")])))


@query(f"WITH {_VIEWS}, a AS (SELECT DISTINCT scene FROM v WHERE \"view\" = 'train'), b AS (SELECT DISTINCT scene FROM v WHERE \"view\" = 'unseen_unseen') SELECT scene AS key, 'missing' AS side FROM a ANTI JOIN b USING (scene) UNION ALL SELECT scene, 'extra' FROM b ANTI JOIN a USING (scene)")
def view_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes that one of two splits alone has."""
    views, masks = _masks(spark, sf_dir)
    return membership.key_difference(masks, views, "scene", "train", "unseen_unseen")


@query(
    f"""
    WITH {_VIEWS}, m AS (SELECT episode, bool_or("view" = 'train') AS a, bool_or("view" = 'monitor') AS b, bool_or("view" = 'seen_seen') AS c, count(*) AS n FROM v WHERE "view" IN ('train', 'monitor', 'seen_seen') GROUP BY episode)
    SELECT array_to_string(list_filter([CASE WHEN a THEN 'train' END, CASE WHEN b THEN 'monitor' END, CASE WHEN c THEN 'seen_seen' END], lambda x: x IS NOT NULL), '+') AS views, count(*) AS episodes, sum(n)::BIGINT AS rows FROM m GROUP BY 1
    """
)
def view_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by the set of splits that hold them."""
    views = membership.Views(["train", "monitor", "seen_seen"])
    masks = views.masks(_rows(spark, sf_dir), {"episode": F.col("episode")})
    names = F.array_join(F.array_compact(F.array(*[F.when(views.held(v), F.lit(v)) for v in views.place])), "+")
    return masks.groupBy(names.alias("views")).agg(F.count("*").alias("episodes"), F.sum(views.total(*views.place)).alias("rows"))
