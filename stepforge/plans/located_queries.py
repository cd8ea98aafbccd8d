"""Queries of releases of step rows that are checked in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepforge.operators import located
from stepforge.plans.registry import query, table
from stepforge.plans.stream_queries import _folder
from stepforge.sources import lines

#: Events as steps of trajectories of four, in a train and a test file, with faults of every kind.
_ROWS = """
    b AS (
        SELECT event_id AS e, event_id // 4 AS t, event_id % 4 AS i, CASE WHEN event_id // 4 % 5 = 0 OR event_id % 307 = 300 THEN 'test' ELSE 'train' END AS role,
               CASE event_id // 4 % 4 WHEN 0 THEN 'turnon' WHEN 1 THEN 'open' WHEN 2 THEN 'puton' ELSE 'placein' END AS family FROM events
    ), l AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY e) AS line FROM b),
    r AS (
        SELECT *, e % 53 <> 1 AS keys, e % 53 <> 1 AND e % 61 <> 3 AND e % 67 <> 4 AS full_, e % 59 <> 2 AND e % 97 <> 10 AS readable,
               CASE WHEN e % 101 = 11 THEN 'fly' WHEN e % 103 = 12 THEN 'walk' WHEN i = 1 AND t % 11 <> 1 THEN 'grab' WHEN i < 3 THEN 'walk' WHEN t % 13 = 1 THEN 'open'
                    ELSE CASE family WHEN 'turnon' THEN 'switchon' WHEN 'open' THEN 'open' WHEN 'puton' THEN 'put' ELSE 'putin' END END AS verb,
               CASE WHEN e % 89 = 9 THEN 9 ELSE i END AS step, CASE WHEN e % 73 = 6 THEN 'nowhere' ELSE 's' || t % 3 END AS scene, CASE WHEN e % 79 = 7 THEN '1' ELSE 'lamp' END AS arg FROM l
    ), u AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM r WHERE full_ AND readable),
    w AS (SELECT t, any_value(family) AS family, count(*) = 4 AND count(DISTINCT step) = 4 AND max(step) = 3 AS whole, count(DISTINCT role) AS roles, count(DISTINCT scene) AS scenes, count(DISTINCT arg) AS args,
                 string_agg(verb, ' ' ORDER BY step, role, line) AS verbs, bool_or(step = 3 AND e % 6 <> 0) AS shown, arg_min(arg, (step, role, line)) AS arg FROM u GROUP BY t)
"""


def _files(spark: SparkSession, sf_dir: str) -> str:
    path = f"{_folder(spark)}/steps"
    e = F.col("event_id")
    t, i = F.expr("event_id div 4"), e % 4
    family = F.element_at(F.array(*map(F.lit, ("turnon", "open", "puton", "placein"))), (t % 4 + 1).cast("int"))
    told = F.when(e % 97 == 10, "Dance").when(family == "turnon", "Turn on lamp").when(family == "open", "Open lamp").when(family == "puton", "Put lamp on table").otherwise("Place lamp in box")
    last = F.when(t % 13 == 1, "open lamp").when(family == "turnon", "switchon lamp").when(family == "open", "open lamp").when(family == "puton", "put lamp table").otherwise("putin lamp box")
    action = F.when(e % 101 == 11, "fly x").when(e % 103 == 12, "walk").when((i == 1) & (t % 11 != 1), "grab lamp").when(i < 3, "walk lamp").otherwise(last)
    seen = F.concat(F.lit("(lamp, is, p"), i.cast("string"), F.lit(")"))
    shown = F.when((i == 3) & (e % 6 != 0), F.when(family == "turnon", "(lamp, is, on)").when(family == "open", "(lamp, is, open)").when(family == "puton", "(lamp, on, table)").otherwise("(lamp, inside, box)"))
    follows = F.coalesce(shown, F.when(e % 10 == 0, seen).otherwise("(lamp, is, off)"))
    role = F.when((t % 5 == 0) | (e % 307 == 300), "test").otherwise("train")
    args = F.when(family.isin("puton", "placein"), F.array(F.lit("lamp"), F.when(family == "puton", "table").otherwise("box"))).otherwise(F.array(F.lit("lamp")))
    split = F.when(e % 71 == 5, "odd").when(role == "test", "unseen_seen").otherwise("seen_seen")
    meta = F.struct(F.when(e % 67 != 4, F.when(e % 73 == 6, "nowhere").otherwise(F.concat(F.lit("s"), (t % 3).cast("string")))).alias("scene"), split.alias("split"), args.alias("task_args"), F.concat(F.lit("t"), t.cast("string")).alias("trajectory_id"), F.when(e % 89 == 9, 9).otherwise(i).cast("int").alias("step_index"), F.lit(4).alias("num_steps"))
    text = F.to_json(F.struct(told.alias("instruction"), F.when(e % 53 != 1, seen).alias("observation"), action.alias("action"), follows.alias("next_observation"), meta.alias("_meta")))
    # a pattern that matches nothing leaves the other rows as they are
    faults = [(e % 59 == 2, r'"instruction":"[^"]*"', '"instruction":5'), (e % 61 == 3, r'"_meta":\{.*\}\}$', '"_meta":"x"}'), (e % 79 == 7, r'"task_args":\["lamp"', '"task_args":[1'), (e % 83 == 8, r'"step_index":(\d)', '"step_index":"$1"')]
    for when, pattern, fault in faults:
        text = F.regexp_replace(text, F.when(when, pattern).otherwise(r"$^"), F.lit(fault))
    lines.write_parts(table(spark, sf_dir, "events").select("event_id", role.alias("role")), path, "role", ["event_id"], text)
    return path


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _files(spark, sf_dir)
    rows = lines.variants(spark, [f"{path}/role=train", f"{path}/role=test"], through=True)
    rows = rows.withColumn("role", F.when(F.col("source") == 0, "train").otherwise("test")).withColumn("split", F.when(F.col("source") == 0, "seen_seen").otherwise("unseen_seen"))
    # a range, whose size is known when the join is planned: by an unknown size the rows of a scene would meet in one task
    return located.checked(rows, spark.range(3).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scene")))


_ERRORS = [
    ("no_observation", "e % 53 = 1"), ("instruction_type", "keys AND e % 59 = 2"), ("meta_type", "keys AND e % 61 = 3"), ("no_meta_scene", "keys AND e % 61 <> 3 AND e % 67 = 4"), ("split", "full_ AND e % 71 = 5"), ("scene", "full_ AND e % 73 = 6"),
    ("task_args", "full_ AND e % 79 = 7"), ("step_type", "full_ AND e % 83 = 8"), ("step_range", "full_ AND e % 83 <> 8 AND e % 89 = 9"), ("instruction", "full_ AND e % 59 <> 2 AND e % 97 = 10"),
    ("verb", "full_ AND readable AND e % 101 = 11"), ("arity", "full_ AND readable AND e % 103 = 12 AND e % 101 <> 11"),
]


@query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT role, line, '{name}' AS error FROM r WHERE {rule}" for name, rule in _ERRORS))
def located_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule about a row, with the file and line of the rows that break it."""
    return located.row_errors(_checked(spark, sf_dir)).select(F.regexp_extract("path", r"role=(\w+)", 1).alias("role"), "line", "error")


_LAST = "CASE family WHEN 'turnon' THEN 'switchon' WHEN 'open' THEN 'open' WHEN 'puton' THEN 'put' ELSE 'putin' END"


def _trajectory_sql(more: str) -> str:
    rules = [("roles", "roles > 1"), ("steps", "NOT whole"), ("mixed_scene", "whole AND scenes > 1"), ("mixed_args", "whole AND args > 1")]
    return f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT 't' || t AS trajectory_id, '{name}' AS error FROM w WHERE {rule}" for name, rule in rules) + more


@query(_trajectory_sql(f" UNION ALL SELECT 't' || t, 'last_verb' FROM w WHERE whole AND split_part(verbs, ' ', 4) <> {_LAST} UNION ALL SELECT 't' || t, 'no_grab' FROM w WHERE whole AND family IN ('puton', 'placein') AND NOT verbs LIKE '%grab%'"))
def located_trajectory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located.trajectory_errors(located.trajectories(_checked(spark, sf_dir)), simple=False)


@query(_trajectory_sql(" UNION ALL SELECT 't' || t, 'verbs' FROM w WHERE whole AND verbs <> CASE family WHEN 'turnon' THEN 'walk switchon' WHEN 'open' THEN 'walk open' WHEN 'puton' THEN 'walk grab walk put' ELSE 'walk grab walk open putin' END"))
def located_verb_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the simple mode, where a family has one sequence of verbs."""
    return located.trajectory_errors(located.trajectories(_checked(spark, sf_dir)), simple=True)


@query(f"WITH {_ROWS} SELECT family, count(*) FILTER (shown AND arg = 'lamp') AS visible, count(*) FILTER (NOT (shown AND arg = 'lamp')) AS hidden FROM w WHERE whole GROUP BY family")
def located_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located.goals_shown(located.trajectories(_checked(spark, sf_dir)))


_VERBS = ["walk", "grab", "open", "switchon", "put", "putin"]


@query(
    f"""
    WITH {_ROWS}, s AS (SELECT 'rows' AS name, count(*) AS n FROM r UNION ALL SELECT 'usable', count(*) FROM u
    UNION ALL SELECT 'with_errors', count(*) FROM r WHERE {" OR ".join(f"({rule})" for _, rule in _ERRORS)}
    {"".join(f" UNION ALL SELECT 'family_{f}', count(*) FROM u WHERE family = '{f}'" for f in ("turnon", "open", "puton", "placein"))}
    {"".join(f" UNION ALL SELECT 'verb_{v}', count(*) FROM u WHERE verb = '{v}' UNION ALL SELECT 'unchanged_{v}', count(*) FROM u WHERE verb = '{v}' AND e % 10 = 0 AND NOT (i = 3 AND e % 6 <> 0)" for v in _VERBS)}
    UNION ALL SELECT 'verb_other', count(*) FROM u WHERE verb = 'fly' UNION ALL SELECT 'unchanged_other', count(*) FROM u WHERE verb = 'fly' AND e % 10 = 0 AND NOT (i = 3 AND e % 6 <> 0)
    UNION ALL SELECT 'is_triples', count(*) FROM u)
    SELECT name, n FROM s
    """
)
def located_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that the scan for errors observes on its way."""
    seen = Observation()
    located.row_errors(located.observed(_checked(spark, sf_dir), seen)).write.format("noop").mode("append").save()
    return spark.createDataFrame(list(seen.get.items()), "name string, n long")


@query(
    f"""
    WITH {_ROWS}, x AS (SELECT family || i || (e % 10 = 0)::INT || (e % 6 <> 0)::INT || CASE WHEN e % 101 = 11 THEN 'fly' WHEN e % 103 = 12 THEN 'bare' ELSE verb END AS row_, role, family || arg AS task FROM u),
    q AS (SELECT t, string_agg(CASE WHEN e % 101 = 11 THEN 'fly' WHEN e % 103 = 12 THEN 'bare' WHEN i = 3 AND t % 13 <> 1 THEN family ELSE verb END, ' ' ORDER BY step, role DESC, line) AS seq, arg_min(family || arg, (step, role = 'test', line)) AS task FROM u GROUP BY t),
    p AS (SELECT DISTINCT q.t, seq, task, role FROM q JOIN u USING (t)),
    n AS (
        SELECT 'task_overlap' AS rule, 'seen/unseen' AS subject, 'error' AS severity, (SELECT count(*) FROM (SELECT task FROM x WHERE role = 'train' INTERSECT SELECT task FROM x WHERE role = 'test')) AS n
        UNION ALL SELECT 'sequence_overlap', 'train/test', 'note', (SELECT count(*) FROM (SELECT seq FROM p WHERE role = 'train' INTERSECT SELECT seq FROM p WHERE role = 'test'))
        UNION ALL SELECT 'task_sequence_overlap', 'train/test', 'note', (SELECT count(*) FROM (SELECT seq, task FROM p WHERE role = 'train' INTERSECT SELECT seq, task FROM p WHERE role = 'test'))
    )
    SELECT rule, subject, severity, n, n > 0 AS broken FROM n
    """
)
def located_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and sequences of actions that both sides of a split hold."""
    rows = _checked(spark, sf_dir)
    return located.overlaps(rows, located.trajectories(rows)).filter("rule <> 'row_overlap'")
