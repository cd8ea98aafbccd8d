"""Queries on audits: joins that must succeed, leakage, equality, rules, replays, text states."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import text as tx
from stepforge.operators import audit
from stepforge.plans.registry import query, table
from stepforge.sources.jsonl import row_hashes, without_done


@query("SELECT doc_id, left(sha256(source || ':' || doc_id::VARCHAR), 24) AS episode_id FROM documents")
def stable_episode_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    given = F.coalesce(F.nullif(path, F.lit("")), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2(given.cast("binary"), 256), F.lit(24)).alias("episode_id"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents) WHERE place = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the hash stands in for the text, so that texts are not shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return audit.first_wins(docs, ["key"], ["doc_id"]).select("doc_id", "lang")


@query(
    """
    SELECT CASE WHEN c_custkey IS NULL THEN 'missing' WHEN NOT (o_custkey % 5 <> c_nationkey % 5) THEN 'mismatch' ELSE 'ok' END AS reason, count(*) AS n
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey GROUP BY 1
    """
)
def strict_lookup_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_nationkey")
    return audit.strict_lookup(table(spark, sf_dir, "orders").select("o_custkey"), dim, "o_custkey", "c_custkey", F.expr("o_custkey % 5 <> c_nationkey % 5"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return without_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def kept_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(kept, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    """
    WITH t AS (SELECT * FROM documents WHERE doc_id % 5 <> 0), h AS (SELECT * FROM documents WHERE doc_id % 5 = 0)
    SELECT 'ids' AS "check", count(*) AS n FROM (SELECT doc_id FROM t INTERSECT SELECT doc_id FROM h)
    UNION ALL SELECT 'texts', count(*) FROM (SELECT text FROM t INTERSECT SELECT text FROM h)
    UNION ALL SELECT 'scenes', count(*) FROM (SELECT source FROM t INTERSECT SELECT source FROM h)
    UNION ALL SELECT 'same_task_texts', count(*) FROM (SELECT lang, text FROM t INTERSECT SELECT lang, text FROM h)
    """
)
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    checks = {"ids": ["doc_id"], "texts": ["key"], "scenes": ["source"], "same_task_texts": ["lang", "key"]}
    return audit.leakage(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"), checks)


@query(
    """
    WITH l AS (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 300 GROUP BY lang), r AS (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 300 OR lang = 'en' GROUP BY lang)
    SELECT coalesce(l.lang, r.lang) AS lang, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right FROM l FULL JOIN r ON l.lang IS NOT DISTINCT FROM r.lang WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)
    """
)
def multiset_view_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars", "lang")
    return audit.multiset_difference(docs.filter("n_chars > 300"), docs.filter("n_chars > 300 or lang = 'en'"), ["lang"])


@query(
    """
    SELECT 'empty_text' AS rule, 'error' AS severity, count(*) FILTER (coalesce(text, '') = '') AS n FROM documents
    UNION ALL SELECT 'length_differs', 'error', count(*) FILTER (n_chars <> length(text)) FROM documents
    UNION ALL SELECT 'very_long', 'warning', count(*) FILTER (n_chars > 10000) FROM documents
    UNION ALL SELECT 'no_task', 'error', count(*) FILTER (lang IS NULL) FROM documents
    """
)
def release_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rules = [
        ("empty_text", "error", F.coalesce(text, F.lit("")) == ""),
        ("length_differs", "error", F.col("n_chars") != F.length(text)),
        ("very_long", "warning", F.col("n_chars") > 10000),
        ("no_task", "error", F.col("lang").isNull()),
    ]
    return audit.rule_report(table(spark, sf_dir, "documents"), rules)


@query("SELECT NOT EXISTS (SELECT 1 FROM documents WHERE coalesce(text, '') = '' OR n_chars <> length(text) OR lang IS NULL) AS valid")
def release_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.valid(release_rules(spark, sf_dir))


@query("WITH n AS (SELECT event_type, (value > 10) AS state, lead(value > 10) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (next = state) AS unchanged FROM n WHERE next IS NOT NULL GROUP BY event_type HAVING count(*) FILTER (next = state) > 0")
def unchanged_transitions_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("value") > 10).alias("state"))
    return audit.unchanged(steps, "user_id", "event_id", "event_type", "state")


@query("SELECT event_type, count(*) FILTER (json_extract(props, '$.k')::INT >= 50) AS visible, count(*) FILTER (json_extract(props, '$.k')::INT < 50) AS hidden FROM events GROUP BY event_type")
def goal_visibility_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    seen = F.when(k >= 50, "visible").when(k < 50, "hidden")
    return table(spark, sf_dir, "events").withColumn("seen", seen).groupBy("event_type").pivot("seen", ["visible", "hidden"]).count().na.fill(0)


@query(
    """
    WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS seq FROM conversations GROUP BY conv_id)
    SELECT count(*) AS n FROM (SELECT seq FROM s WHERE conv_id % 4 = 0 INTERSECT SELECT seq FROM s WHERE conv_id % 4 <> 0)
    """
)
def action_sequence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepforge.operators.episodes import assembled

    rows = assembled(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role"]).select("conv_id", F.array_join("steps.role", ">").alias("seq"))
    return audit.overlap(rows.filter("conv_id % 4 = 0"), rows.filter("conv_id % 4 <> 0"), ["seq"])


@query("SELECT role, count(*) AS n, count(*) FILTER (conv_id % 9 = 0) AS missing, count(*) FILTER (conv_id % 9 <> 0 AND turn % 4 = 3) AS mismatched FROM conversations GROUP BY role")
def replay_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    replayed = stored.filter("conv_id % 9 <> 0").withColumn("text", F.when(F.col("turn") % 4 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return audit.replay_mismatches(stored, replayed.select("conv_id", "turn", "text"), ["conv_id", "turn"], "text", ["role"])


@query(
    """
    WITH e AS (SELECT DISTINCT source FROM documents WHERE n_chars > 9000), a AS (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 2000)
    SELECT source, 'missing' AS side FROM (SELECT source FROM e EXCEPT SELECT source FROM a) UNION ALL SELECT source, 'extra' FROM (SELECT source FROM a EXCEPT SELECT source FROM e)
    """
)
def expected_scene_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars", "lang", "source")
    return audit.difference(docs.filter("n_chars > 9000").select("source").distinct(), docs.filter("lang = 'es' and n_chars > 2000").select("source").distinct())


@query(
    """
    SELECT o_orderkey, sha256('{"o_custkey": ' || o_custkey || ', "o_orderkey": ' || o_orderkey || ', "o_orderpriority": "' || o_orderpriority || '", "o_orderstatus": "' || o_orderstatus || '", "place": {"a": "caf\\u00e9", "b": ' || o_orderkey % 7 || '}}') AS sha256 FROM orders
    """
)
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct((F.col("o_orderkey") % 7).alias("b"), F.lit("café").alias("a")).alias("place")
    return row_hashes(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", place), "o_orderkey")


@query(
    r"""
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 WHEN len(p) = 0 THEN 1 ELSE len(p) END::BIGINT AS n_sentences, md5(CASE WHEN coalesce(text, '') = '' THEN '' WHEN len(p) = 0 THEN text ELSE array_to_string(p, chr(1)) END) AS parts
    FROM (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(\r\n|\n|\r)', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '') AS p FROM documents)
    """
)
def sentence_state_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tx.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.md5(F.array_join(parts, "\x01").cast("binary")).alias("parts"))


@query(r"SELECT page_id, CASE WHEN len(m) = 0 THEN 1 ELSE len(m) END::BIGINT AS n_states, CASE WHEN len(m) = 0 THEN html ELSE '(' || trim(m[1]) || ')' END AS first_state FROM (SELECT page_id, html, regexp_extract_all(html, '\(([^()]*)\)', 1) AS m FROM pages)")
def html_tuple_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = tx.triple_texts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(states).cast("long").alias("n_states"), F.get(states, F.lit(0)).alias("first_state"))


#: Passages of fewer than seven words that meet a text at a time.
SHORT_PASSAGES = 1_000
#: Longer passages that are broadcast; where there are more, only numbers of documents and passages meet on runs.
PASSAGES = 10_000


@query("SELECT b.item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def verbatim_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage: they meet on the passage's first word runs, then the texts are compared.

    Up to PASSAGES passages come to the texts, which are then read once and not shuffled. Passages of fewer than seven words have no run of
    five whole words; they are looked for in every text, a block of them at a time."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")).filter("passage is not null")
    inner = F.split("passage", " ")
    short = items.filter(F.size(inner) < 7)
    # runs of five words are told apart by their hash; the texts decide
    items = items.filter(F.size(inner) >= 7).withColumn("anchor", F.xxhash64(F.array_join(F.slice(inner, 2, 5), " ")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    words = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text", F.split("text", " ").alias("words"))
    # an expression of array functions would split the text again for every run
    runs = NGram(n=5, inputCol="words", outputCol="runs").transform(words).select("doc", "doc_id", "text", F.explode("runs").alias("run"))
    anchors = runs.withColumn("anchor", F.xxhash64("run"))
    held = F.contains("text", F.col("passage"))
    if items.count() <= PASSAGES:
        same = items.groupBy("item_id", "passage", "anchor").agg(F.count("*").alias("times"))
        hits = anchors.join(F.broadcast(same), "anchor").filter(held).select("doc", "item_id", F.xxhash64("passage").alias("of"), "times").distinct().select("item_id", "times")
    else:
        pairs = anchors.select("doc_id", "anchor").join(items.select("anchor", "item_id"), "anchor").select("doc_id", "item_id").distinct()
        hits = pairs.join(docs, "doc_id").join(items.select("item_id", "passage"), "item_id").filter(held).select("item_id", F.lit(1).cast("long").alias("times"))
    if n := short.count():
        blocks = -(-n // SHORT_PASSAGES)
        short = short.groupBy(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("item_id", "passage")).alias("of"))
        every = docs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(short), "block")
        inside = F.explode(F.filter("of", lambda p: F.contains("text", p["passage"])))
        hits = hits.union(every.select(inside.alias("p")).select("p.item_id", F.lit(1).cast("long")))
    return hits.groupBy("item_id").agg(F.sum("times").alias("n_docs"))
