"""Queries on scene graphs: triples, containment, best nodes, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import text as tx
from stepforge.operators import graph
from stepforge.plans.registry import query, table


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as objects with states in the rooms of their nations; the first supplier of a nation is its agent."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("scene"), F.col("s_suppkey").alias("k"), "s_acctbal")
    first = own.groupBy("scene").agg(F.min("k").alias("agent"))
    own = own.join(first, "scene")
    things = own.select(
        "scene", F.col("k").alias("pos"), F.col("k").alias("id"), F.when(F.col("k") == F.col("agent"), "character").otherwise(F.concat(F.lit("thing_"), (F.col("k") % 7).cast("string"))).alias("class_name"),
        F.when(F.col("k") == F.col("agent"), "Characters").when(F.col("k") % 7 == 6, "Walls").otherwise("Props").alias("category"), F.array(F.when(F.col("k") % 2 == 0, "OPEN").otherwise("CLOSED"), F.lit("DIRTY")).alias("states"),
    )
    room = first.select("scene", (-F.col("agent") - 1).alias("pos"), (-F.col("agent") - 1).alias("id"), F.lit("dining_room").alias("class_name"), F.lit("Rooms").alias("category"), F.array().cast("array<string>").alias("states"))
    inside = own.select("scene", F.col("k").alias("from_id"), (-F.col("agent") - 1).alias("to_id"), F.lit("INSIDE").alias("relation_type"))
    close = own.filter("k <> agent").select("scene", F.col("agent").alias("from_id"), F.col("k").alias("to_id"), F.when(F.col("k") % 5 == 0, "HOLDS_RH").otherwise("CLOSE").alias("relation_type"))
    return things.unionByName(room), inside.unionByName(close)


_SCENE_SQL = """
WITH f AS (SELECT s_nationkey::VARCHAR AS scene, s_suppkey AS k, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS agent FROM supplier),
n AS (SELECT *, CASE WHEN k = agent THEN 'character' ELSE 'thing_' || (k % 7) END AS name, k <> agent AND k % 7 = 6 AS wall FROM f),
t AS (
    SELECT scene, name AS s, 'is' AS r, CASE WHEN k % 2 = 0 THEN 'open' ELSE 'closed' END AS o FROM n WHERE NOT wall
    UNION SELECT scene, name, 'inside', 'kitchen' FROM n WHERE NOT wall
    UNION SELECT scene, 'character', CASE WHEN k % 5 = 0 THEN 'hold' ELSE 'close' END, name FROM n WHERE k <> agent AND NOT wall
    UNION SELECT scene, 'character', 'hold', 'none' FROM n GROUP BY scene HAVING count(*) FILTER (k <> agent AND k % 5 = 0) = 0
)
"""


@query(_SCENE_SQL + "SELECT scene, string_agg('(' || s || ', ' || r || ', ' || o || ')', ', ' ORDER BY s, r, o) AS observation FROM t GROUP BY scene")
def triple_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.observations(*_scene(spark, sf_dir))


@query(_SCENE_SQL + "SELECT scene, s, r, o FROM t")
def triple_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triple_render(spark, sf_dir).select("scene", F.inline(tx.triples(F.col("observation"))))


@query(_SCENE_SQL + "SELECT r, count(*) AS n FROM t GROUP BY r")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triple_parse(spark, sf_dir).groupBy("r").agg(F.count("*").alias("n"))


@query(_SCENE_SQL + "SELECT scene, count(*) FILTER (r = 'hold' AND o = 'thing_3') > 0 AS holds FROM t GROUP BY scene")
def relation_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.has_relation(*_scene(spark, sf_dir), "character", "HOLDS_RH", "thing_3")


@query("SELECT 'c' || c_custkey AS node, 'r' || n_regionkey AS root, 2::BIGINT AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation")
def containment_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    return graph.containment_roots(customers.unionByName(nations), table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node")))


_NEST = """
    WITH RECURSIVE e AS (
        SELECT event_id AS child, event_id - 1 AS parent FROM events WHERE event_id % 700 <> 0
        UNION ALL SELECT event_id, event_id - 40 FROM events WHERE event_id % 700 > 40 AND event_id % 97 = 5
    ), walk AS (
        SELECT event_id AS node, event_id AS root, 0::BIGINT AS depth FROM events WHERE event_id % 700 = 0
        UNION SELECT child, root, depth + 1 FROM walk JOIN e ON parent = node WHERE child % 700 <> 0
    )
"""


@query(_NEST + "SELECT node, min(root) AS root, min(depth) AS depth FROM walk WHERE node % 700 <> 0 GROUP BY node")
def deep_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events nested up to 700 deep, some in two others; the nearest roots by doubled pointers."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id")
    pair = lambda rows, parent: rows.select(k.alias("child"), parent.alias("parent"))
    edges = pair(events.filter(k % 700 != 0), k - 1).unionByName(pair(events.filter((k % 700 > 40) & (k % 97 == 5)), k - 40))
    return graph.containment_roots(edges, events.filter(k % 700 == 0).select(k.alias("node")))


@query("SELECT p_brand, p_type, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY (p_size > 25) DESC, p_name LIKE 'red%' DESC, p_partkey) AS place FROM part) WHERE place = 1")
def best_node_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return graph.best_nodes(nodes, ["p_brand", "p_type"], [F.col("p_size") > 25, F.col("p_name").startswith("red")])


_PLAN_SQL = """
WITH t AS (SELECT p_partkey AS task_id, p_partkey % 4 AS k, replace(p_name, ' ', '_') AS o, CASE WHEN p_size > 10 THEN 'room' || p_size % 3 END AS r, CASE WHEN p_size % 6 = 0 THEN 'fridge' END AS i, CASE WHEN p_partkey % 4 = 2 THEN 'table' ELSE 'box' END AS target, p_size % 2 = 0 AS closed FROM part)
SELECT task_id, concat_ws('; ', 'walk ' || r, 'walk ' || i, 'open ' || i, 'walk ' || o, CASE WHEN k = 0 THEN 'switchon ' || o END, CASE WHEN k = 1 THEN 'open ' || o END, CASE WHEN k >= 2 THEN 'grab ' || o END,
    CASE WHEN k >= 2 THEN 'walk hall' END, CASE WHEN k >= 2 THEN 'walk ' || target END, CASE WHEN k = 3 AND closed THEN 'open ' || target END, CASE WHEN k = 2 THEN 'put ' || o || ' ' || target END, CASE WHEN k = 3 THEN 'putin ' || o || ' ' || target END) AS steps FROM t
"""


@query(_PLAN_SQL)
def planner_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    tasks = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"),
        F.when(k == 0, "turnon").when(k == 1, "open").when(k == 2, "puton").otherwise("placein").alias("family"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("object"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("room"), (F.col("p_size") % 3).cast("string"))).alias("object_room"),
        F.when(F.col("p_size") % 6 == 0, "fridge").alias("object_inside"),
        F.when(k == 2, "table").otherwise("box").alias("target"),
        F.lit("hall").alias("target_room"),
        (F.col("p_size") % 2 == 0).alias("target_closed"),
    )
    return graph.plan_steps(tasks)


@query(
    """
    WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, replace(p_name, ' ', '_') AS a, p_brand AS b FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 'turnon' WHEN 1 THEN 'open' WHEN 2 THEN 'puton' ELSE 'placein' END AS family,
        CASE k WHEN 0 THEN '(' || a || ', is, on)' WHEN 1 THEN '(' || a || ', is, open)' WHEN 2 THEN '(' || a || ', on, ' || b || ')' ELSE '(' || a || ', inside, ' || b || ')' END AS goal FROM t
    """
)
def goal_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, args = F.col("p_partkey") % 4, F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_brand"))
    family = F.when(k == 0, "turnon").when(k == 1, "open").when(k == 2, "puton").otherwise("placein")
    rows = table(spark, sf_dir, "part").select("p_partkey", tx.task_family(tx.instruction(family, args)).alias("family"), args.alias("args"))
    return rows.select("p_partkey", "family", tx.rendered_triples(F.array(tx.goal(F.col("family"), F.col("args")))).alias("goal"))


@query("WITH f AS (SELECT s_nationkey::VARCHAR AS scene, s_suppkey AS k, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS agent FROM supplier) SELECT scene, min(CASE WHEN k <> agent AND k % 5 = 0 THEN lpad(k::VARCHAR, 12, '0') || ' thing_' || (k % 7) END)[14:] AS held FROM f GROUP BY scene")
def held_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _scene(spark, sf_dir)
    return graph.held_objects(nodes, edges.withColumn("pos", F.col("to_id")))


@query("WITH f AS (SELECT s_nationkey::VARCHAR AS scene, s_suppkey AS k, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS agent FROM supplier) SELECT scene, count(*) FILTER (k <> agent AND k % 7 = 3 AND k % 2 = 0) > 0 AS holds FROM f GROUP BY scene")
def node_has_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.has_state(_scene(spark, sf_dir)[0], "thing_3", "OPEN")
