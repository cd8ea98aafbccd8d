"""Queries that write and read files: line-JSON, partitioned splits, staged releases, scans of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.operators import planning
from stepforge.plans.registry import query, table
from stepforge.plans.stream_queries import _folder
from stepforge.sources import jsonl, lines

_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/customers"
    jsonl.write_jsonl(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return jsonl.read_jsonl(spark, path, _CUSTOMER)


@query("SELECT c_mktsegment AS parent_split, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer GROUP BY c_mktsegment")
def split_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a folder per split, found again by the names of the folders."""
    path = f"{_folder(spark)}/splits"
    jsonl.write_jsonl(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path, ["c_mktsegment"])
    rows = jsonl.scan(spark, path, "c_custkey long", "*.json")
    return rows.groupBy(F.regexp_extract("parent", "=(.*)$", 1).alias("parent_split")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("SELECT n_nationkey, n_name FROM nation")
def staged_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second release of a table, swapped in after its rows were counted."""
    path, rows = f"{_folder(spark)}/release", table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    jsonl.swap_in(rows.filter("n_nationkey < 5"), path, lambda d: d.count() == 5)
    expected = rows.count()
    jsonl.swap_in(rows, path, lambda d: d.count() == expected)
    return spark.read.parquet(path)


@query(
    """
    WITH e AS (SELECT event_id, event_id % 3 AS file, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line FROM events)
    SELECT file::INTEGER AS file, line, CASE WHEN event_id % 97 = 0 THEN 'broken' WHEN event_id % 89 = 0 THEN 'blank' ELSE 'other_type' END AS kind FROM e WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 101 = 0
    """
)
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three files; the lines that are blank, no JSON, or no rows of the schema."""
    path, k = f"{_folder(spark)}/lines", F.col("event_id")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    text = F.when(k % 97 == 0, "{").when(k % 89 == 0, "").when(k % 101 == 0, '{"event_id": "none"}').otherwise(good)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (k % 3).cast("int").alias("file"))
    lines.write_parts(rows, path, "file", ["event_id"], text)
    found = jsonl.malformed(spark, [f"{path}/file={i}" for i in range(3)], "event_id long, event_type string, value double", blank_is_error=True, through=True)
    kind = F.when(F.trim("text") == "", "blank").when(F.col("text") == "{", "broken").otherwise("other_type")
    return found.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file"), "line", kind.alias("kind"))


_MIXED = """
    WITH e AS (
        SELECT *, (conv_id % 2)::INTEGER AS file, row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id, turn, role, text) AS line,
               CASE conv_id % 3 WHEN 0 THEN 'steps' WHEN 1 THEN 'episodes' ELSE 'other' END AS kind FROM conversations
    )
"""


def _mixed(spark: SparkSession, sf_dir: str) -> list[str]:
    """Turns of conversations in two files, as steps, episodes and rows of no kind."""
    path, c = f"{_folder(spark)}/mixed", F.col("conv_id")
    said, turn = F.substring(F.regexp_replace("text", r"[^a-z]+", ""), 1, 5), F.col("turn").cast("string")
    step = F.struct(F.lit("do").alias("instruction"), F.concat(F.lit("(a, is, "), said, F.lit("), (b, on, "), turn, F.lit(")")).alias("observation"), F.col("role").alias("action"), F.when(F.col("turn") % 2 == 0, said).otherwise("").alias("next_observation"))
    episode = F.struct(F.col("role").alias("task"), F.array(F.struct(F.concat(F.lit("It is "), said, F.lit(". Turn "), turn, F.lit("!")).alias("observation"), F.lit("end").alias("next_observation"))).alias("history"))
    other = F.struct(said.alias("z"), F.col("turn").alias("n"), F.col("role").alias("a"))
    value = F.when(c % 3 == 0, F.to_json(step)).when(c % 3 == 1, F.to_json(episode)).otherwise(F.to_json(other))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (c % 2).cast("int").alias("file"))
    lines.write_parts(rows, path, "file", ["conv_id", "turn", "role", "text"], value)
    return [f"{path}/file={i}" for i in range(2)]


@query(
    _MIXED
    + """
    , s AS (SELECT file, line, kind, turn, role, left(regexp_replace(text, '[^a-z]+', '', 'g'), 5) AS said FROM e),
    t AS (
        SELECT file, line, unnest(CASE kind
            WHEN 'steps' THEN ['(a, is, ' || said || ')', '(b, on, ' || turn || ')'] || CASE WHEN turn % 2 = 0 AND said <> '' THEN [said] ELSE [] END
            WHEN 'episodes' THEN ['It is ' || said || '.', 'Turn ' || turn || '!', 'end']
            ELSE [said, role] END) AS text, generate_subscripts(CASE kind WHEN 'steps' THEN [1, 2] || CASE WHEN turn % 2 = 0 AND said <> '' THEN [3] ELSE [] END WHEN 'episodes' THEN [1, 2, 3] ELSE [1, 2] END, 1) AS i
        FROM s
    )
    SELECT file, line, (i - 1)::INTEGER AS pos, text FROM t
    """
)
def mixed_prototype_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State texts of files that mix steps, episodes and other rows, each by its own kind."""
    texts = lines.prototype_rows(spark, _mixed(spark, sf_dir), through=True)
    return texts.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file"), "line", "pos", "text")


@query(_MIXED + "SELECT kind, file, count(*) AS n, min(line) AS first FROM e GROUP BY kind, file")
def mixed_row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.variants(spark, _mixed(spark, sf_dir), through=True)
    return rows.groupBy(lines.kind_of_row(F.col("row")).alias("kind"), F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file")).agg(F.count("*").alias("n"), F.min("line").alias("first"))


_STEPS = """
    WITH s AS (
        SELECT *, CASE WHEN turn = 0 AND conv_id % 4 = 1 THEN NULL WHEN conv_id % 7 <> 3 THEN turn END AS step_index, CASE WHEN conv_id % 5 <> 2 THEN 't' || conv_id END AS own,
               row_number() OVER (ORDER BY conv_id % 2, conv_id, turn, role, text) AS place FROM conversations
    ), n AS (SELECT place, 'legacy-row-' || row_number() OVER (ORDER BY place) - 1 AS loose FROM s WHERE own IS NULL)
"""


@query(
    _STEPS
    + """
    SELECT coalesce(own, loose) AS trajectory_id, count(*)::INTEGER AS n, string_agg(role || turn, ' ' ORDER BY coalesce(step_index, 0), s.place) AS steps
    FROM s LEFT JOIN n ON n.place = s.place GROUP BY coalesce(own, loose)
    """
)
def evaluation_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step rows of two files as trajectories in order; rows without an id are episodes of their own, steps without a number come first."""
    path, c, turn = _folder(spark), F.col("conv_id"), F.col("turn")
    index = F.when((turn == 0) & (c % 4 == 1), None).when(c % 7 != 3, turn)
    meta = F.struct(F.when(c % 5 != 2, F.concat(F.lit("t"), c.cast("string"))).alias("trajectory_id"), index.alias("step_index"))
    value = F.to_json(F.struct(F.lit("i").alias("instruction"), F.lit("o").alias("observation"), F.concat("role", turn.cast("string")).alias("action"), F.lit("n").alias("next_observation"), meta.alias("_meta")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (c % 2).cast("int").alias("file"))
    lines.write_parts(rows, path, "file", ["conv_id", "turn", "role", "text"], value)
    kind, found = lines.evaluation_rows(spark, [f"{path}/file={i}" for i in range(2)], through=True)
    assert kind == "steps"
    return found.select("trajectory_id", F.size("steps").alias("n"), F.array_join("steps.action", " ").alias("steps"))


@query("SELECT event_type AS task, file::INTEGER AS file, count(*) AS n, sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 2 END)::BIGINT AS steps, min(line) AS first FROM (SELECT *, event_id % 2 AS file, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS line FROM events) GROUP BY 1, 2")
def evaluation_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes of two files, known by the history of the first row; some are empty."""
    path, k = _folder(spark), F.col("event_id")
    step = F.struct(F.lit("o").alias("observation"), F.col("event_type").alias("action"), F.lit("n").alias("next_observation"))
    history = F.when(k % 11 == 0, F.array().cast("array<struct<observation:string,action:string,next_observation:string>>")).otherwise(F.array(step, step))
    value = F.to_json(F.struct(F.col("event_type").alias("task"), k.cast("string").alias("trial_name"), history.alias("history")))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (k % 2).cast("int").alias("file"))
    lines.write_parts(rows, path, "file", ["event_id"], value)
    kind, found = lines.evaluation_rows(spark, [f"{path}/file={i}" for i in range(2)], through=True)
    assert kind == "episodes"
    return found.groupBy("task", F.col("source").alias("file")).agg(F.count("*").alias("n"), F.sum(F.size("history")).cast("long").alias("steps"), F.min("line").alias("first"))


@query("SELECT type AS task_type, scene AS scene_num, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'pick_heat' ELSE 'look_at' END AS type, p_size::INTEGER AS scene FROM part WHERE p_partkey % 10 <> 9) GROUP BY 1, 2")
def game_path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task and scene read off paths; paths of another form are dropped."""
    family = F.when(F.col("p_partkey") % 2 == 0, "pick_heat").otherwise("look_at")
    good = F.concat(F.lit("train/"), family, F.lit("-Apple-None-Table-"), F.col("p_size").cast("string"), F.lit("/trial_"), F.col("p_partkey").cast("string"), F.lit("/game.tw"))
    paths = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 9, F.concat(F.lit("odd/"), "p_name", F.lit("/x/y"))).otherwise(good).alias("path"))
    fields = paths.select(jsonl.game_fields(F.col("path")).alias("g")).filter("g is not null")
    return fields.groupBy(F.col("g.task_type").alias("task_type"), F.col("g.scene_num").alias("scene_num")).agg(F.count("*").alias("n"))


@query(
    """
    WITH a AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
    g AS (SELECT user_id, count(*) FILTER (ok) AS ok FROM a WHERE place <= 30 GROUP BY user_id HAVING count(*) FILTER (ok) >= 3),
    r AS (SELECT user_id % 7 AS base, user_id AS scene, ok, row_number() OVER (PARTITION BY user_id % 7 ORDER BY user_id) AS place FROM g)
    SELECT base, scene, ok FROM r WHERE place <= 3
    """
)
def scene_probe_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose first probes succeed often enough, a few per base."""
    events = table(spark, sf_dir, "events")
    attempts = events.select(F.col("user_id").alias("scene"), F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("ok"))
    scenes = events.select((F.col("user_id") % 7).alias("base"), F.col("user_id").alias("scene")).distinct()
    return planning.probed(scenes, attempts, "base", "scene", 3, 30, 3).select("base", "scene", "ok")
