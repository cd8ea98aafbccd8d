"""Queries of the checks: steps, trajectories, episodes, releases, lookups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators import validation
from stepforge.plans.registry import query, table

_META = "trajectory_id:string,scene:string,split:string,task_args:array<string>,step_index:int,num_steps:int"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as steps of their orders, with errors of every kind."""
    i, flag = F.col("l_linenumber"), F.col("l_returnflag")
    action = F.when(flag == "A", F.when(i == 2, "put a").otherwise("put a b")).when(flag == "N", "walk b").when(i == 3, F.lit(None)).otherwise("fly a")
    meta = F.struct(
        F.col("l_orderkey").cast("string").alias("trajectory_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 11).cast("string")).alias("scene"), F.when(F.col("l_discount") == 0.1, "test").otherwise("train").alias("split"),
        F.when(F.col("l_tax") == 0.08, F.lit(None)).otherwise(F.array(F.lit("a"), F.when(F.col("l_tax") != 0.07, F.lit("b")))).alias("task_args"), (i - 1).alias("step_index"), F.lit(4).alias("num_steps"),
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("Do it").alias("instruction"), F.col("l_linestatus").alias("observation"), action.alias("action"),
        F.when(F.col("l_quantity") <= 45, F.col("l_linestatus")).alias("next_observation"), F.when(F.col("l_quantity") != 50, meta).alias("_meta"),
    )


_STEP_SQL = """
WITH s AS (
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_quantity <> 50 AS has, l_suppkey % 11 AS scene, l_linenumber - 1 AS i,
           CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber = 2 THEN 'put a' ELSE 'put a b' END WHEN 'N' THEN 'walk b' ELSE CASE WHEN l_linenumber = 3 THEN NULL ELSE 'fly a' END END AS action
    FROM lineitem
), e AS (
    SELECT 'no_action' AS error, count(*) AS n FROM s WHERE action IS NULL
    UNION ALL SELECT 'no_next_observation', count(*) FROM s WHERE l_quantity > 45
    UNION ALL SELECT 'no_meta', count(*) FROM s WHERE NOT has
    UNION ALL SELECT 'no_meta_task_args', count(*) FROM s WHERE has AND l_tax = 0.08
    UNION ALL SELECT 'split', count(*) FROM s WHERE has AND l_discount = 0.1
    UNION ALL SELECT 'step_range', count(*) FROM s WHERE has AND i >= 4
    UNION ALL SELECT 'task_args', count(*) FROM s WHERE has AND l_tax = 0.07
    UNION ALL SELECT 'verb', count(*) FROM s WHERE action = 'fly a'
    UNION ALL SELECT 'arity', count(*) FROM s WHERE action = 'put a'
    UNION ALL SELECT 'scene', count(*) FROM s WHERE has AND scene >= 9
)
SELECT error, n FROM e WHERE n > 0
"""


@query(_STEP_SQL)
def step_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = spark.createDataFrame([(f"s{i}",) for i in range(9)], ["scene"])
    return validation.step_errors(_steps(spark, sf_dir), ["l_orderkey", "l_linenumber"], "train", scenes).groupBy("error").agg(F.count("*").alias("n"))


_TALK_SQL = """
WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) + (conv_id % 9 = 0)::INT AS n, CASE conv_id % 4 WHEN 0 THEN 'turnon' WHEN 1 THEN 'open' WHEN 2 THEN 'puton' ELSE 'placein' END AS family FROM conversations),
l AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM c),
s AS (
    SELECT *, CASE WHEN is_last AND conv_id % 5 <> 0 THEN CASE family WHEN 'turnon' THEN 'switchon' WHEN 'open' THEN 'open' WHEN 'puton' THEN 'put' ELSE 'putin' END WHEN turn = 0 AND conv_id % 3 <> 0 THEN 'grab' ELSE 'walk' END AS verb FROM l
), t AS (
    SELECT conv_id, any_value(family) AS family, count(*) <> max(n) AS broken, max(turn) AS last, any_value(CASE WHEN is_last THEN verb END) AS last_verb, bool_or(verb = 'grab') AS grab FROM s GROUP BY conv_id
), e AS (
    SELECT conv_id, 'steps' AS error FROM t WHERE broken
    UNION ALL SELECT conv_id, 'mixed_scene' FROM t WHERE NOT broken AND conv_id % 7 = 0 AND last >= 1
    UNION ALL SELECT conv_id, 'mixed_args' FROM t WHERE NOT broken AND conv_id % 8 = 0 AND last >= 1
    UNION ALL SELECT conv_id, 'last_verb' FROM t WHERE NOT broken AND last_verb <> CASE family WHEN 'turnon' THEN 'switchon' WHEN 'open' THEN 'open' WHEN 'puton' THEN 'put' ELSE 'putin' END
    UNION ALL SELECT conv_id, 'no_grab' FROM t WHERE NOT broken AND family IN ('puton', 'placein') AND NOT grab
    UNION ALL SELECT conv_id, 'goal' FROM t WHERE NOT broken AND NOT (conv_id % 6 <> 0 AND family = 'turnon')
    UNION ALL SELECT conv_id, 'unaligned' FROM t WHERE NOT broken AND conv_id % 10 = 0 AND last >= 1
)
SELECT conv_id::VARCHAR AS trajectory_id, error FROM e
"""


@query(_TALK_SQL)
def trajectory_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trajectories; every kind of error in some of them."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"))
    size = talks.groupBy("conv_id").agg(F.count("*").alias("k"), F.max("turn").alias("end"))
    rows = talks.join(size, "conv_id")
    c, first, last = F.col("conv_id"), F.col("turn") == 0, F.col("turn") == F.col("end")
    family = F.element_at(F.array(*map(F.lit, ("turnon", "open", "puton", "placein"))), (c % 4 + 1).cast("int"))
    ends = F.create_map(*[F.lit(x) for pair in validation.LAST_VERB.items() for x in pair])
    verb = F.when(last & (c % 5 != 0), F.element_at(ends, family)).when(first & (c % 3 != 0), "grab").otherwise("walk")
    seen = F.concat(F.lit("(place, is, p"), F.col("turn").cast("string"), F.lit(")"))
    follows = F.concat(F.lit("(place, is, p"), (F.col("turn") + 1).cast("string"), F.lit(")"))
    follows = F.when(last & (c % 6 != 0), F.lit("(lamp, is, on), (a, close, lamp)")).when(c % 10 == 0, F.lit("(other, is, off)")).otherwise(follows)
    meta = F.struct(
        c.cast("string").alias("trajectory_id"), F.when((c % 7 == 0) & first, "other").otherwise("home").alias("scene"), F.lit("train").alias("split"),
        F.when((c % 8 == 0) & first, F.array(F.lit("table"))).otherwise(F.array(F.lit("lamp"))).alias("task_args"), F.col("turn").alias("step_index"), (F.col("k") + (c % 9 == 0).cast("int")).cast("int").alias("num_steps"),
    )
    steps = rows.select(F.concat(verb, F.lit(" lamp")).alias("action"), seen.alias("observation"), follows.alias("next_observation"), meta.alias("_meta"), family.alias("family"))
    return validation.trajectory_errors(steps, F.col("family"))


@query(
    """
    WITH h AS (SELECT user_id AS u, event_id AS e, event_type AS a FROM events WHERE user_id % 12 <> 5),
    u AS (
        SELECT u, arg_max(a, e) AS last, bool_or(a <> 'view' OR u % 9 <> 4) AS acts, max(CASE WHEN a = 'purchase' THEN 1.0 ELSE 0.0 END) AS best FROM h GROUP BY u
    ), every AS (SELECT DISTINCT user_id AS u FROM events)
    SELECT 'u' || u AS episode_id, 'no_task' AS error FROM every WHERE u % 10 = 3
    UNION ALL SELECT 'u' || u, 'no_trial' FROM every WHERE u % 14 = 6
    UNION ALL SELECT 'u' || u, 'empty_history' FROM every WHERE u % 12 = 5
    UNION ALL SELECT 'u' || u, 'no_action' FROM u WHERE NOT acts
    UNION ALL SELECT 'u' || u, 'not_done' FROM u WHERE last <> 'purchase'
    UNION ALL SELECT 'u' || u, 'no_success' FROM u WHERE last <> 'purchase' AND u % 2 = 0
    """
)
def episode_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as episodes of all that they did, in order; some did nothing, of some no action is told."""
    u, done = F.col("user_id"), F.col("event_type") == "purchase"
    told = F.when((u % 9 != 4) | (F.col("event_type") != "view"), F.col("event_type"))
    step = F.struct("event_id", F.lit("o").alias("observation"), told.alias("action"), done.cast("double").alias("reward"), done.alias("dones"), F.lit("o").alias("next_observation"))
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(u % 12 != 5, step))).alias("history"))
    meta = F.struct(F.concat(F.lit("u"), u.cast("string")).alias("episode_id"), (u % 2 == 0).alias("expert_success"))
    rows = own.select(F.when(u % 10 != 3, "look").alias("task"), F.when(u % 14 != 6, "t").alias("trial_name"), "history", meta.alias("_meta"))
    return validation.episode_errors(rows)


@query(
    """
    SELECT 'all' AS "view", 'repeated' AS error, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'eval', 'shared with train', count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 5 IN (0, 1) INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0) HAVING count(*) > 0
    UNION ALL SELECT 'eval', 'not in all', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 IN (0, 1) EXCEPT SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
    """
)
def release_view_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    views = {"all": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "eval": orders.filter("id % 5 in (0, 1)"), "train": orders.filter("id % 5 > 0")}
    return validation.release_report(views, "id", [("eval", "train")], [("eval", "all")])


@query(
    """
    SELECT o_orderkey, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN o_orderstatus = 'P' THEN 'mismatch' ELSE 'ok' END AS reason,
           CASE WHEN s_suppkey IS NOT NULL AND o_orderstatus <> 'P' THEN s_name ELSE 'old' END AS name, o_orderpriority AS priority, 'eval' AS benchmark_split,
           CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'unseen' ELSE 'seen' END AS scene_split
    FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 200
    """
)
def enriched_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup whose fields win over those of the rows, then fields of the split."""
    meta = F.struct(F.lit("old").alias("name"), F.col("o_orderpriority").alias("room_type"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 200).alias("key"), meta.alias("_meta"))
    dim = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.struct(F.col("s_name").alias("name")).alias("_meta"))
    out = validation.tagged(validation.enriched(rows, dim, "key", F.col("o_orderstatus") != "P"), "benchmark_split", "eval")
    out = validation.scene_split(out, "room_type", ["1-URGENT", "5-LOW"])
    return out.select("o_orderkey", "reason", "_meta.name", F.col("_meta.room_type").alias("priority"), "_meta.benchmark_split", "_meta.scene_split")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) <= 37 AS held_out FROM documents")
def exact_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 37 documents are held out, the first in a seeded order."""
    return validation.exact_split(table(spark, sf_dir, "documents").select("doc_id"), 37, 5, "doc_id")


@query(
    """
    WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang),
    s AS (SELECT *, sum(n) OVER () AS total, 101 * n // sum(n) OVER () AS base, (101 * n) % sum(n) OVER () AS rest FROM c),
    q AS (SELECT source, lang, base + (row_number() OVER (ORDER BY rest DESC, n DESC, source, lang) <= 101 - sum(base) OVER ())::BIGINT AS quota FROM s)
    SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('8:' || doc_id), doc_id) <= quota AS held_out FROM documents JOIN q USING (source, lang)
    """
)
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 101 documents are held out, each source and language giving its share by largest remainders."""
    rows = validation.exact_split(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), 101, 8, "doc_id", ["source", "lang"])
    return rows.select("doc_id", "held_out")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INTEGER AS pos, part AS text FROM (SELECT conv_id, turn, k, CASE k WHEN 0 THEN 'Turn ' || turn || '.' WHEN 1 THEN 'By ' || role || '!' ELSE 'end' END AS part FROM conversations, range(3) r(k))")
def prototype_state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes; the sentences of both observations of every step, in order."""
    seen = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(". By "), F.col("role"), F.lit("!"))
    steps = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", seen.alias("observation"), F.lit("end").alias("next_observation")).alias("h"))
    return validation.prototype_texts(steps.groupBy("conv_id").agg(F.array_sort(F.collect_list("h")).alias("history")), "conv_id")


@query(
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'turnon' WHEN 1 THEN 'open' WHEN 2 THEN 'puton' ELSE 'placein' END AS family, event_id % 5 < 3 AND NOT (event_id % 5 = 2 OR event_id % 3 = 0) AND event_id % 7 <> 6 AS valid FROM events
    """
)
def semantic_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of four families about objects of their own, whose goals hold and show at the end and do not show at the start."""
    k = F.col("event_id")
    family = F.element_at(F.array(*map(F.lit, ("turnon", "open", "puton", "placein"))), (k % 4 + 1).cast("int"))
    one, other = F.concat(F.lit("a"), F.col("user_id").cast("string")), F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string"))
    args = F.when(family.isin("turnon", "open"), F.array(one)).otherwise(F.array(one, other))
    holds = F.concat(F.lit("("), one, F.when(family == "turnon", ", is, on)").when(family == "open", ", is, open)").when(family == "puton", F.concat(F.lit(", on, "), other, F.lit(")"))).otherwise(F.concat(F.lit(", inside, "), other, F.lit(")"))))
    # of some the goal holds for another object alone
    end = F.when(k % 7 == 6, F.concat(F.lit("(z"), F.substring(holds, 2, 100))).when(k % 5 < 3, F.concat(holds, F.lit(", (room, close, door)"))).otherwise("(room, is, dark)")
    start = F.when((k % 5 == 2) | (k % 3 == 0), holds).otherwise("(room, is, dark)")
    ok = validation.semantically_valid(validation.goal_satisfied(end, family, args), start, end, family, args)
    return table(spark, sf_dir, "events").select("event_id", family.alias("family"), ok.alias("valid"))
