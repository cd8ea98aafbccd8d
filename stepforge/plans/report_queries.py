"""Queries on rollouts, candidate grids and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators import reports, rollout
from stepforge.plans.registry import query, table
from stepforge.plans.split_queries import members


@query()
def simulated_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on a cup: seeing it is walking to it, clicking grabs it, signing up walks to the table, buying puts it there."""
    said = F.when(F.col("event_type") == "view", "walk cup").when(F.col("event_type") == "click", "grab cup").when(F.col("event_type") == "signup", "walk table").when(F.col("event_type") == "purchase", "put cup table").otherwise("fly")
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("step"), said.alias("action"))
    goals = actions.select("episode", F.lit("cup").alias("s"), F.lit("on").alias("r"), F.lit("table").alias("o")).distinct()
    return rollout.rollouts(actions, goals)


@query(
    """
    WITH m AS (SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
    t AS (SELECT DISTINCT p_brand, length(p_brand) AS n FROM part), s AS (SELECT DISTINCT s_nationkey FROM supplier)
    SELECT CASE WHEN m.p_brand IS NULL THEN 'missing_object' WHEN n > 7 THEN 'too_long' ELSE 'ok' END AS reason, count(*) AS n
    FROM s CROSS JOIN t LEFT JOIN m ON m.s_nationkey = s.s_nationkey AND m.p_brand = t.p_brand GROUP BY 1
    """
)
def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("task"), "p_brand")
    return rollout.candidate_reasons(tasks, table(spark, sf_dir, "supplier"), members(spark, sf_dir), "s_nationkey", "p_brand", [("too_long", F.length("task") > 7)])


@query("SELECT o_orderpriority || chr(9) || o_orderstatus || chr(9) || printf('%.6f', count(*)::DOUBLE) AS line FROM orders GROUP BY o_orderpriority, o_orderstatus")
def metric_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return reports.metric_lines(counts, ["o_orderpriority", "o_orderstatus"], ["n"])


@query("SELECT p_partkey, '[PUT] <' || p_name || '> (' || p_partkey || ') <' || p_brand || '> (' || p_size || ')' AS line FROM part")
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = reports.script_line(F.lit("put"), F.array("p_name", "p_brand"), F.array("p_partkey", F.col("p_size").cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query("SELECT event_id, k::INTEGER AS dim, round(CASE WHEN k % 2 = 0 THEN sin((event_id % 512) / pow(10000.0, (k // 2) * 2 / 8.0)) ELSE cos((event_id % 512) / pow(10000.0, (k // 2) * 2 / 8.0)) END, 6) + 0.0 AS value FROM events, range(8) u(k)")
def positional_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded by their place in windows of 512."""
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(reports.positional(F.col("event_id") % 512, 8)).alias("dim", "value"))
    return rows.select("event_id", "dim", (F.round("value", 6) + 0.0).alias("value"))
