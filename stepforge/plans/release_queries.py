"""Queries of release building: candidates, balanced scenes, clusters, views, re-splits, variants and the model store."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import text as tx
from stepforge.operators import planning, releases, splits, stages, store, validation
from stepforge.plans.registry import query, table
from stepforge.plans.stream_queries import _folder
from stepforge.sources import archives, jsonl

_GOALS = {"puton": 2, "placein": 1}
_OWNED = "SELECT DISTINCT s_nationkey AS scene, p_brand AS class FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey"
_HAVING = {"HAS_SWITCH": "class < 'Brand#2'", "CAN_OPEN": "class LIKE '%4'", "GRABBABLE": "class < 'Brand#15'", "SURFACES": "class > 'Brand#12'", "CONTAINERS": "class LIKE '%1_' OR class LIKE '%9'"}


def _having(name: str) -> str:
    return f"(SELECT scene, class FROM o WHERE {_HAVING[name]})"


_CANDIDATES_SQL = f"""
WITH o AS ({_OWNED}), goals AS (SELECT scene, class FROM o WHERE class <> 'Brand#4'),
single AS (
    SELECT 'turnon' AS family, class AS args, count(*) AS n FROM {_having("HAS_SWITCH")} WHERE class <> 'Brand#4' GROUP BY class
    UNION ALL SELECT 'open', class, count(*) FROM {_having("CAN_OPEN")} WHERE class <> 'Brand#4' GROUP BY class
), hosts AS (
    SELECT 'puton' AS family, scene, class FROM {_having("SURFACES")} WHERE class NOT IN ('Brand#4', 'Brand#20')
    UNION ALL SELECT 'placein', scene, class FROM {_having("CONTAINERS")} WHERE class <> 'Brand#4'
), pairs AS (
    SELECT family, g.class || '|' || h.class AS args, g.class AS a, h.class AS b, count(*) AS n FROM {_having("GRABBABLE")} g JOIN hosts h ON g.scene = h.scene AND g.class <> h.class GROUP BY ALL
), puton AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS place FROM pairs WHERE family = 'puton' QUALIFY place <= 24
), placein AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS place FROM pairs WHERE family = 'placein' AND args NOT IN (SELECT args FROM puton) QUALIFY place <= 21)
SELECT family, args, place::INTEGER AS place FROM (
    SELECT family, args, row_number() OVER (PARTITION BY family ORDER BY n DESC, args) AS place FROM single
    UNION ALL SELECT family, args, place FROM puton UNION ALL SELECT family, args, place FROM placein)
"""


@query(_CANDIDATES_SQL)
def candidate_plan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of all four families over brands that nations hold."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    lines = lines.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    members = lines.select(F.col("s_nationkey").alias("scene"), F.col("p_brand").alias("class")).distinct()
    classes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class")).distinct()
    properties = classes.select("class", F.explode(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in _HAVING.items()]))).alias("property"))
    found = releases.candidates(members, properties, _GOALS, 12, ("Brand#4",), ("Brand#20",))
    return found.select("family", F.array_join("args", "|").alias("args"), "place")


_SCENES_SQL = """
WITH c AS (SELECT p_type AS room, p_size % 12 AS scene, p_brand AS task, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT DISTINCT room, scene FROM c), k AS (SELECT room, count(*) AS scenes FROM s GROUP BY room), t AS (SELECT room, task, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT s.room, s.scene, t.task, coalesce(c.n, 0)::DOUBLE AS n, greatest(1.0, t.total * 3.0 / k.scenes) AS target FROM s JOIN t USING (room) JOIN k USING (room) LEFT JOIN c ON c.room = s.room AND c.scene = s.scene AND c.task = t.task),
p AS (
    SELECT a.room, a.scene AS x, b.scene AS y, d.scene AS z, count(*) FILTER (a.n + b.n + d.n > 0) AS covered, min(a.n + b.n + d.n) AS least,
           round(sum(abs(a.n + b.n + d.n - a.target) / a.target), 9) AS off, sum(a.n + b.n + d.n) AS total
    FROM g a JOIN g b ON a.room = b.room AND a.task = b.task AND a.scene < b.scene JOIN g d ON a.room = d.room AND a.task = d.task AND b.scene < d.scene GROUP BY ALL)
SELECT room, x || ' ' || y || ' ' || z AS scenes FROM p QUALIFY row_number() OVER (PARTITION BY room ORDER BY covered DESC, least DESC, off, total DESC, x + y + z, x, y, z) = 1
"""


@query(_SCENES_SQL)
def balanced_scene_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the 9 to 12 scenes of each room."""
    parts = table(spark, sf_dir, "part")
    counts = parts.groupBy(F.col("p_type").alias("room"), (F.col("p_size") % 12).alias("scene"), F.col("p_brand").alias("task")).agg(F.count("*").alias("n"))
    return releases.balanced_scenes(counts, 0.28).select("room", F.array_join("scenes", " ").alias("scenes"))


_LPT_SQL = """
RECURSIVE s AS (SELECT p_size AS scene, row_number() OVER (ORDER BY count(*) DESC, p_size % 4, p_size) AS place, count(*) AS n FROM part WHERE p_size % 10 <> 7 GROUP BY p_size),
step AS (
    SELECT 0::BIGINT AS place, [0, 0, 0]::BIGINT[] AS rows, [0, 0, 0]::BIGINT[] AS scenes, 0::BIGINT AS took
    UNION ALL
    SELECT place, list_transform(rows, lambda x, i: CASE WHEN i = took THEN x + n ELSE x END), list_transform(scenes, lambda x, i: CASE WHEN i = took THEN x + 1 ELSE x END), took
    FROM (SELECT s.place, s.n, rows, scenes, list_sort(list_transform([1, 2, 3], lambda i: [rows[i], scenes[i], i]))[1][3] AS took FROM step JOIN s ON s.place = step.place + 1)
)"""


@query(f"WITH {_LPT_SQL} SELECT scene::INTEGER AS scene, 'c' || (took - 1) AS cluster, n FROM step JOIN s USING (place)")
def scene_cluster_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.clusters(_train_scenes(spark, sf_dir), _CLUSTERS)


_CLUSTERS = ["c0", "c1", "c2"]


def _train_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size % 10 <> 7").groupBy(F.col("p_size").alias("scene")).agg(F.count("*").alias("n")).withColumn("room", F.col("scene") % 4)


_MONITOR_SQL = f"""
WITH {_LPT_SQL}, known AS (SELECT scene, 'c' || (took - 1) AS cluster FROM step JOIN s USING (place)),
m AS (SELECT p_partkey, p_size AS scene, cluster FROM part LEFT JOIN known ON scene = p_size WHERE p_partkey % 3 = 0),
loose AS (SELECT *, row_number() OVER (ORDER BY scene, p_partkey) AS nth FROM m WHERE cluster IS NULL),
turn AS (
    SELECT 0::BIGINT AS nth, [(SELECT count(*) FROM m WHERE cluster = 'c0'), (SELECT count(*) FROM m WHERE cluster = 'c1'), (SELECT count(*) FROM m WHERE cluster = 'c2')]::BIGINT[] AS load, 0::BIGINT AS took
    UNION ALL
    SELECT nth + 1, list_transform(load, lambda x, i: CASE WHEN i = next THEN x + 1 ELSE x END), next
    FROM (SELECT *, list_sort(list_transform([1, 2, 3], lambda i: [load[i], i]))[1][2] AS next FROM turn WHERE nth < (SELECT count(*) FROM loose))
)
SELECT p_partkey, cluster, false AS monitor_only FROM m WHERE cluster IS NOT NULL UNION ALL SELECT p_partkey, 'c' || (took - 1), true FROM loose JOIN turn USING (nth)
"""


@query(_MONITOR_SQL)
def monitor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor rows by cluster; those of scenes without training rows go where fewest are."""
    placed = releases.clusters(_train_scenes(spark, sf_dir), _CLUSTERS)
    rows = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select("p_partkey", "p_size")
    return releases.with_cluster(rows, placed, _CLUSTERS, "p_size", "p_partkey").select("p_partkey", "cluster", "monitor_only")


@query(
    """
    WITH p AS (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'monitor' WHEN doc_id % 10 = 8 THEN 'seen_seen' ELSE 'unseen_seen' END AS part, 'c' || doc_id % 3 AS c FROM documents)
    SELECT 'fine_tuning' AS "view", CASE part WHEN 'train' THEN 'train' ELSE 'test' END AS file, doc_id FROM p WHERE part IN ('train', 'monitor')
    UNION ALL SELECT 'adapter', CASE part WHEN 'train' THEN 'train' ELSE 'test' END, doc_id FROM p WHERE part IN ('train', 'monitor')
    UNION ALL SELECT 'retrieval', 'index', doc_id FROM p WHERE part = 'train'
    UNION ALL SELECT 'world_model/' || c, CASE part WHEN 'train' THEN 'train' ELSE 'test' END, doc_id FROM p WHERE part IN ('train', 'monitor')
    UNION ALL SELECT 'eval/' || part, 'test', doc_id FROM p WHERE part IN ('seen_seen', 'unseen_seen')
    """
)
def method_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five families of views of a release."""
    d = F.col("doc_id") % 10
    part = F.when(d < 6, "train").when(d < 8, "monitor").when(d == 8, "seen_seen").otherwise("unseen_seen")
    rows = table(spark, sf_dir, "documents").select("doc_id", part.alias("part"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("c"))
    return releases.method_views(rows, "part", "c").select("view", "file", "doc_id")


_FILES_SQL = """
WITH d AS (SELECT doc_id, lang, source, source NOT IN ('src17', 'src18', 'src19') AS known, lang IN ('fr', 'es') AS new FROM documents),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('9:' || doc_id::VARCHAR), doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.1, 0)::BIGINT) AS held FROM d WHERE known AND NOT new),
f AS (SELECT doc_id, lang, source, CASE WHEN held THEN 'test' ELSE 'train' END AS file FROM h
      UNION ALL SELECT doc_id, lang, source, 'test' FROM d WHERE NOT known UNION ALL SELECT doc_id, lang, source, 'test_unseen_task' FROM d WHERE new)
"""


def _resplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return releases.resplit_by_unseen_task(docs, "source", "lang", "doc_id", [f"src{i}" for i in range(17)], ["fr", "es"], 0.1, 9)


@query(_FILES_SQL + "SELECT doc_id, file FROM f")
def resplit_unseen_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resplit(spark, sf_dir).select("doc_id", "file")


@query(
    _FILES_SQL
    + """SELECT doc_id, 'task_' || lang AS target FROM f WHERE source <> 'src17' AND file <> 'test' UNION ALL SELECT doc_id, 'seen_task_seen_scene' FROM f WHERE source <> 'src17' AND file = 'test'
    UNION ALL SELECT doc_id, 'unseen_task_seen_scene' FROM f WHERE source <> 'src17' AND file = 'test_unseen_task'
    UNION ALL SELECT doc_id, 'seen_task_unseen_scene' FROM f WHERE source = 'src17' AND file = 'test' AND lang NOT IN ('fr', 'es')
    UNION ALL SELECT doc_id, 'unseen_task_unseen_scene' FROM f WHERE source = 'src17' AND file = 'test_unseen_task'"""
)
def resplit_task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = [r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().collect()]  # the task types
    return releases.resplit_by_task_type(_resplit(spark, sf_dir), "source", "lang", "src17", [x for x in langs if x not in ("fr", "es")]).select("doc_id", "target")


_TID = "'s' || conv_id % 3 || ':' || CASE conv_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'puton' ELSE 'turnon' END || ':a:b|' || conv_id"


@query(
    f"""
    WITH s AS (SELECT turn, {_TID} AS tid, string_split({_TID}, ':')[2] AS family FROM conversations WHERE conv_id % 4 <> 0),
    b AS (SELECT tid FROM (SELECT DISTINCT tid, family FROM s) QUALIFY row_number() OVER (PARTITION BY family ORDER BY sha256('4:' || tid), tid) <= 5)
    SELECT 'full' AS variant, tid, family, turn FROM s UNION ALL SELECT 'balanced', tid, family, turn FROM s WHERE tid IN (SELECT tid FROM b)
    """
)
def evaluation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trajectories, all and five of each family."""
    split = F.when(F.col("conv_id") % 4 == 0, "unseen_seen").otherwise("seen_seen")
    kind = F.element_at(F.array(*map(F.lit, ("open", "puton", "turnon"))), (F.col("conv_id") % 3 + 1).cast("int"))
    tid = F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"), F.lit(":"), kind, F.lit(":a:b|"), F.col("conv_id").cast("string"))
    steps = table(spark, sf_dir, "conversations").select("turn", tid.alias("tid"), split.alias("split"))
    return releases.evaluation_variants(steps, "tid", "split", 5, 4).select("variant", "tid", releases.family_of(F.col("tid")).alias("family"), "turn")


@query(
    """
    WITH q AS (SELECT lang, greatest(1, round_even(60.0 * count(*) / (SELECT count(*) FROM documents), 0))::BIGINT AS quota FROM documents GROUP BY lang),
    r AS (SELECT lang, quota, row_number() OVER (ORDER BY quota DESC, lang) AS place, 60 - sum(quota) OVER () AS short FROM q),
    f AS (SELECT lang, quota + CASE WHEN place <= abs(short) THEN sign(short) ELSE 0 END AS quota FROM r)
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY sha256('8:' || doc_id::VARCHAR), doc_id) <= quota THEN 'seen' ELSE 'unseen' END AS task_split FROM documents d JOIN f ON f.lang = d.lang
    """
)
def expected_task_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks, sixty of them seen."""
    return releases.expected_task_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, 8).select("doc_id", "task_split")


@query("SELECT p_size, p_brand, p_partkey, row_number() OVER (ORDER BY p_size, p_brand, p_partkey) - 1 AS place FROM part")
def episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order of scene, task and trial."""
    return releases.numbered(table(spark, sf_dir, "part").select("p_size", "p_brand", "p_partkey"), ["p_size", "p_brand", "p_partkey"])


@query("SELECT n_nationkey FROM nation ORDER BY sha256('6:' || n_nationkey::VARCHAR), n_nationkey LIMIT 7")
def checked_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rows in a seeded order; fewer would be an error."""
    return validation.shuffled_take(table(spark, sf_dir, "nation").select("n_nationkey"), 7, 6, "n_nationkey")


@query(
    """
    WITH s AS (SELECT n_name AS model, row_number() OVER (ORDER BY n_nationkey) AS nth FROM nation),
    a AS (SELECT model, nth FROM s UNION ALL SELECT 'new', 3.5), b AS (SELECT model, row_number() OVER (ORDER BY nth) AS nth FROM a),
    c AS (SELECT * FROM b WHERE nth < (SELECT max(nth) FROM b) AND model <> (SELECT model FROM s WHERE nth = 2)), d AS (SELECT model, row_number() OVER (ORDER BY nth DESC) - 1 AS pos FROM c)
    SELECT model, ((pos - 2) // 3)::INTEGER AS pos FROM d WHERE pos BETWEEN 2 AND 20 AND pos % 3 = 2
    """
)
def store_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model put in, the last and a named one taken out, the order turned, and a slice of it."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("model"))
    _, rest = store.popped(store.inserted(nations, 3, spark.createDataFrame([("new",)], "model string")))
    second = nations.filter("pos = 1").first().model
    return store.sliced(store.backwards(store.removed(rest, second)), 2, 21, 3)


@query("SELECT label::VARCHAR AS query, r::INTEGER AS rank, ['2', '0', '5'][r] AS model FROM (SELECT DISTINCT label FROM embeddings), range(1, 4) t(r)")
def fixed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed models for every query where no prototypes are given."""
    return store.selected_models(table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("model")), ["2", "0", "5"])


@query(
    """
    WITH l AS (SELECT o_orderkey, list(l_suppkey ORDER BY l_suppkey) AS s, list(l_partkey ORDER BY l_partkey) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber < 4 GROUP BY o_orderkey)
    SELECT o_orderkey, unnest(range(least(len(s), len(list_distinct(p)))))::INTEGER AS pos, unnest(s[:least(len(s), len(list_distinct(p)))]) AS a, unnest(list_sort(list_distinct(p))[:least(len(s), len(list_distinct(p)))]) AS b FROM l
    """
)
def paired_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of an order paired by place, the rest of the longer one left out."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber < 4").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    lists = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("s"), F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return lists.select("o_orderkey", F.posexplode(validation.paired(F.col("s"), F.col("p"))).alias("pos", "x")).select("o_orderkey", "pos", F.col("x.left").alias("a"), F.col("x.right").alias("b"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'walk a' WHEN 1 THEN 'open ' || event_id WHEN 2 THEN 'put b' WHEN 3 THEN '' ELSE 'one' END AS action FROM events")
def decoded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with and without markers, several lines and none."""
    k = F.col("event_id")
    answer = F.when(k % 5 == 0, F.lit("user x assistant y assistant\n\n walk a \nmore")).when(k % 5 == 1, F.concat(F.lit("assistant<|end_header_id|>\nopen "), k.cast("string"), F.lit("<|eot_id|>rest<|eot_id|>"))).when(k % 5 == 2, "  put b").when(k % 5 == 3, "assistant \n ").otherwise("<|end_header_id|>one\n<|end_header_id|>two")
    return table(spark, sf_dir, "events").select("event_id", tx.decoded_action(answer).alias("action"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer")
def first_row_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the keys of the first line: later keys are left out, missing ones are null."""
    path, k = f"{_folder(spark)}/like", F.col("c_custkey")
    last = table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, F.to_json(F.struct(k.alias("id"), F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("name")))).alias("value"), (k % 5 == 0).alias("short"))
    last.orderBy("short").coalesce(1).select("value").write.text(path)
    return jsonl.read_like_first(spark, path).select("id", "name")


@query("SELECT r_regionkey::INTEGER AS region, r_name AS name FROM region")
def compatible_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file folder that a second reader finds at its own path."""
    path = _folder(spark)
    table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("region"), F.col("r_name").alias("name")).write.json(f"{path}/views/eval")
    jsonl.copied(spark, f"{path}/views/eval", f"{path}/eval")
    return spark.read.schema("region int, name string").json(f"{path}/eval")


@query(
    """
    WITH m AS (SELECT n_regionkey AS r, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY sha256('2:scenes/r' || n_regionkey || '/' || n_nationkey || '.json')) AS nth FROM nation WHERE n_nationkey % 3 <> 0)
    SELECT 'r' || r AS base, (nth - 1)::INTEGER AS pos, 'scenes/r' || r || '/' || k || '.json' AS member, k::BIGINT AS id FROM m WHERE nth <= 2
    """
)
def zip_scene_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fitting members of an archive for each base, in a seeded order; reading stops there."""
    path = _folder(spark)
    key = F.col("n_nationkey")
    scenes = table(spark, sf_dir, "nation").select(F.lit("scenes").alias("archive"), F.format_string("scenes/r%d/%d.json", F.col("n_regionkey"), key).alias("member"), F.format_string('{"id": %d}', key).alias("payload"))
    archives.write(scenes.union(spark.createDataFrame([("scenes", "readme.txt", "no scene")], scenes.schema)), path)
    member = F.col("member")
    found = archives.picked(spark, path, r"^scenes/.*\.json$", F.split(member, "/")[1], [F.sha2(F.concat(F.lit("2:"), member), 256)], 2, lambda x: x["id"] % 3 != 0, strict=False)
    return found.select("base", "pos", "member", F.get_json_object("payload", "$.id").cast("long").alias("id"))


@query("SELECT c_custkey % 4 AS archive, count(*) AS n, sum(length('{\"id\": ' || c_custkey || '}'))::BIGINT AS size, sum(c_custkey)::BIGINT AS total FROM customer WHERE (c_custkey // 40) % 2 = 0 GROUP BY 1")
def zip_member_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of four archives, written by tasks; the filter on names reaches the reader, which takes ranges of members."""
    path, key = f"{_folder(spark)}/zips", F.col("c_custkey")
    name = F.format_string("%s/%d.json", F.when(F.expr("(c_custkey div 40) % 2 = 0"), "even").otherwise("odd"), key)
    rows = table(spark, sf_dir, "customer").select((key % 4).alias("archive"), name.alias("member"), F.format_string('{"id": %d}', key).alias("payload"))
    archives.write(rows, path)
    found = archives.members(spark, path, payload=True, range_=50).filter(F.col("member").startswith("even/"))
    number = F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long")
    return found.groupBy(number.alias("archive")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.get_json_object(F.col("payload").cast("string"), "$.id").cast("long")).alias("total"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey))::INTEGER AS rank FROM part")
def unseen_task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks by their unseen and their valid scenes."""
    return planning.unseen_order(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice", "p_partkey").select("p_partkey", "rank")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, sha256('4:' || doc_id), doc_id) - 1 AS place FROM documents")
def held_out_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shuffled, then sorted by source: one source in the order of the shuffle."""
    return planning.held_out_order(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4).select("doc_id", "place")


@query(
    """
    WITH s AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('11:' || o_orderkey), o_orderkey) <= greatest(1, round_even(count(*) OVER (PARTITION BY o_orderpriority) * 0.2, 0)::BIGINT) AS held, o_orderpriority, o_custkey % 4 AS c FROM orders)
    SELECT CASE WHEN held THEN 'monitor' ELSE 'train' END AS part, 'c' || c AS cluster, o_orderpriority AS task, count(*) AS n FROM s GROUP BY 1, 2, 3
    """
)
def resumed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release in three stages; the first run stops after the second one, the next goes on from there."""
    folder = _folder(spark)

    def counted(fails: bool):
        def make(_: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
            if fails:
                raise InterruptedError
            return t["views"].groupBy("part", "cluster", F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("n"))

        return make

    def plan(fails: bool) -> list[stages.Stage]:
        return [
            stages.Stage("orders", lambda s, _: table(s, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")),
            stages.Stage("views", lambda _, t: splits.holdout(t["orders"], ["o_orderpriority"], "o_orderkey", 0.2, 11).select("*", F.when(F.col("held_out"), "monitor").otherwise("train").alias("part"), F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")).alias("cluster")), ("orders",)),
            stages.Stage("counts", counted(fails), ("views",)),
        ]

    with contextlib.suppress(InterruptedError):
        stages.build(spark, folder, plan(True), sf_dir)
    tables, made = stages.build(spark, folder, plan(False), sf_dir)
    assert made == ["counts"]
    return tables["counts"]
