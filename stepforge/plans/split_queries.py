"""Queries on splits, planning and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions.stats import counted_rank
from stepforge.operators import planning, retrieval, splits
from stepforge.plans.registry import query, table

UNSEEN_TASKS, UNSEEN_SCENES = ["fr", "es"], ["src16", "src17", "src18", "src19"]
_TAGGED = """SELECT doc_id, lang, source, CASE WHEN lang IN ('fr', 'es') THEN 'unseen' ELSE 'seen' END AS task_split,
CASE WHEN source IN ('src16', 'src17', 'src18', 'src19') THEN 'unseen' ELSE 'seen' END AS scene_split FROM documents"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.seen_tags(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", UNSEEN_TASKS, UNSEEN_SCENES)


@query(f"SELECT *, task_split || '_' || scene_split AS quadrant, task_split || '_' || scene_split = 'seen_seen' AS zero_shot FROM ({_TAGGED})")
def quadrant_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir)


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 12 THEN 'kitchen' WHEN p_size BETWEEN 13 AND 24 THEN 'livingroom' WHEN p_size BETWEEN 25 AND 36 THEN 'bedroom' WHEN p_size BETWEEN 37 AND 45 THEN 'bathroom' END AS room FROM part")
def range_room_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = [(1, 12, "kitchen"), (13, 24, "livingroom"), (25, 36, "bedroom"), (37, 45, "bathroom")]
    return table(spark, sf_dir, "part").select("p_partkey", splits.room_of(F.col("p_size"), rooms).alias("room"))


_THREE_SQL = """
WITH s AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n,
    row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS place FROM documents),
c AS (SELECT *, greatest(round_even(n * 0.1, 0)::BIGINT, CASE WHEN n >= 20 THEN 1 ELSE 0 END) AS e0, greatest(round_even(n * 0.1, 0)::BIGINT, CASE WHEN n >= 20 THEN 1 ELSE 0 END) AS m0 FROM s),
d AS (SELECT *, CASE WHEN e0 + m0 >= n THEN greatest(0, least(e0, n - 1)) ELSE e0 END AS e FROM c),
f AS (SELECT *, CASE WHEN e0 + m0 >= n THEN greatest(0, least(m0, n - e - 1)) ELSE m0 END AS m FROM d)
SELECT doc_id, lang, source, CASE WHEN place <= e THEN 'eval' WHEN place <= e + m THEN 'monitor' ELSE 'train' END AS split FROM f
"""


@query(_THREE_SQL)
def stratified_three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1, 0.1, 42)


@query(
    """
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.1, 0)::BIGINT) AS held_out FROM documents
    """
)
def holdout_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 0.1, 7)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id::VARCHAR), doc_id) AS place FROM documents) WHERE place <= 25")
def balanced_sample_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 25, 3)


@query("SELECT doc_id FROM documents ORDER BY sha256('5:' || doc_id::VARCHAR), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.select_samples(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 5)


_DOWN_SQL = f"""
WITH t AS (SELECT doc_id, lang, source, task_split || '_' || scene_split AS quadrant FROM ({_TAGGED})),
p AS (SELECT *, quadrant = 'seen_seen' OR row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1 OR row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS prot FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY prot ORDER BY CASE quadrant WHEN 'unseen_unseen' THEN 1 WHEN 'unseen_seen' THEN 2 WHEN 'seen_unseen' THEN 3 ELSE 4 END, sha256('11:' || doc_id::VARCHAR), doc_id) AS place FROM p)
SELECT doc_id, quadrant, prot OR place > greatest(0, (SELECT count(*) FROM t) - (SELECT count(*) * 9 // 10 FROM t)) AS kept FROM r
"""


@query(_DOWN_SQL)
def protected_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(spark, sf_dir).select("doc_id", "lang", "source", "quadrant")
    order = ["unseen_unseen", "unseen_seen", "seen_unseen", "seen_seen"]
    kept = splits.protected_downsample(rows, "doc_id", "quadrant", "lang", "source", rows.count() * 9 // 10, order, 11)
    return kept.select("doc_id", "quadrant", "kept")


@query()
def eval_holdout_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.eval_spread(table(spark, sf_dir, "documents"), "lang", "source", "doc_id", 25)


_STATS_SQL = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderpriority, n FROM orders JOIN n ON l_orderkey = o_orderkey),
g AS (SELECT o_orderpriority, list_sort(list(n)) AS xs, avg(n) AS mean FROM o GROUP BY o_orderpriority)
SELECT o_orderpriority, len(xs)::BIGINT AS episodes, round(mean, 6) AS mean_steps, median(n)::DOUBLE AS median_steps, xs[1] AS min_steps, xs[len(xs)] AS max_steps,
       xs[floor(0.1 * (len(xs) - 1))::INT + 1] AS p10_steps, xs[floor(0.9 * (len(xs) - 1))::INT + 1] AS p90_steps
FROM g JOIN o USING (o_orderpriority) GROUP BY o_orderpriority, xs, mean
"""


@query(_STATS_SQL)
def split_counts_lower_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(steps, F.col("o_orderkey") == F.col("l_orderkey"))
    # ranks come from the histogram of lengths, which is small, and not from lists of rows
    lengths = rows.groupBy("o_orderpriority", "n").agg(F.count("*").alias("c")).groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    upto = F.aggregate("h", F.array().cast("array<long>"), lambda a, x: F.array_append(a, x["c"] + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))))
    at = lambda place: F.get(F.col("h.n"), F.size(F.filter("upto", lambda c: c <= place)))
    low = lambda p: at(F.floor(F.lit(p) * (F.col("episodes") - 1)))
    out = lengths.withColumn("episodes", total).withColumn("upto", upto)
    mean = F.aggregate("h", F.lit(0.0), lambda a, x: a + x["n"] * x["c"]) / F.col("episodes")
    median = (at(F.floor((F.col("episodes") - 1) / 2)) + at(F.floor(F.col("episodes") / 2))) / F.lit(2.0)
    return out.select("o_orderpriority", "episodes", F.round(mean, 6).alias("mean_steps"), median.alias("median_steps"), at(F.lit(0)).alias("min_steps"), at(F.col("episodes") - 1).alias("max_steps"), low(0.1).alias("p10_steps"), low(0.9).alias("p90_steps"))


@query("SELECT conv_len AS length, p90 FROM (SELECT 'turns' AS conv_len, list_sort(list(n))[floor(0.9 * (count(*) - 1))::INT + 1] AS p90 FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id))")
def conversation_length_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    # a row for each length, of which there are few
    lengths = n.groupBy(F.col("n").alias("value")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("h"))
    return lengths.select(F.lit("turns").alias("length"), counted_rank(F.col("h"), 0.9).alias("p90"))


@query(
    """
    SELECT task AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'X') AS X
    FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', '6-NEVER']) AS task) LEFT JOIN orders ON o_orderpriority = task GROUP BY task
    """
)
def task_room_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.task_room_matrix(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "6-NEVER"], ["F", "O", "P", "X"])


@query("SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def distribution_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "mean_chars")


_MEMBERS = "SELECT DISTINCT s_nationkey, p_brand, p_type FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    lines = lines.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.select("s_nationkey", "p_brand", "p_type").distinct()


@query(f"SELECT p_brand, coverage, row_number() OVER (ORDER BY coverage DESC, p_brand)::INTEGER AS rank FROM (SELECT p_brand, count(DISTINCT s_nationkey) AS coverage FROM ({_MEMBERS}) GROUP BY p_brand)")
def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.coverage_rank(members(spark, sf_dir), "s_nationkey", "p_brand")


_PAIRS = f"WITH m AS ({_MEMBERS}) SELECT a.p_brand AS p_brand, b.p_type AS p_type, count(DISTINCT a.s_nationkey) AS joint FROM m a JOIN m b ON a.s_nationkey = b.s_nationkey AND a.p_brand <> b.p_type GROUP BY a.p_brand, b.p_type"


@query(_PAIRS)
def joint_coverage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = members(spark, sf_dir)
    return planning.joint_coverage(own, own, "s_nationkey", "p_brand", "p_type")


_TOP = f"SELECT p_brand, p_type, joint, row_number() OVER (ORDER BY joint DESC, p_brand, p_type)::INTEGER AS rank FROM ({_PAIRS})"


@query(f"WITH t AS ({_TOP}), rest AS (SELECT p_brand, p_type, joint FROM t WHERE rank > 30) SELECT * FROM (SELECT p_brand, p_type, joint, row_number() OVER (ORDER BY joint DESC, p_brand, p_type)::INTEGER AS rank FROM rest) WHERE rank <= 32")
def pair_anti_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = members(spark, sf_dir)
    pairs = planning.joint_coverage(own, own, "s_nationkey", "p_brand", "p_type")
    first = planning.top_pairs(pairs, "p_brand", "p_type", 30)
    return planning.top_pairs(planning.without_pairs(pairs, first, "p_brand", "p_type"), "p_brand", "p_type", 32)


_QUOTA_SQL = """
WITH q AS (SELECT lang, greatest(1, round_even(16.0 * count(*) / (SELECT count(*) FROM documents), 0))::BIGINT AS quota FROM documents GROUP BY lang),
r AS (SELECT lang, quota, row_number() OVER (ORDER BY quota DESC, lang) AS place, 16 - sum(quota) OVER () AS short FROM q)
SELECT lang, (quota + CASE WHEN place <= abs(short) THEN sign(short) ELSE 0 END)::BIGINT AS quota FROM r
"""


@query(_QUOTA_SQL)
def family_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {r["lang"]: r["count"] for r in table(spark, sf_dir, "documents").groupBy("lang").count().collect()}  # a row per family
    return spark.createDataFrame(list(planning.quotas(counts, 16, sum(counts.values())).items()), "lang string, quota long")


@query(
    """
    WITH RECURSIVE t AS (
        SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS k, list_filter(s, lambda x: x < 12) AS own, len(s) AS valid
        FROM (SELECT p_brand, list(DISTINCT s_nationkey) AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY p_brand)
    ), g AS (
        SELECT 0 AS n, []::BIGINT[] AS chosen, []::BIGINT[] AS covered
        UNION ALL
        SELECT n + 1, list_append(chosen, -best[5]), list_distinct(covered || (SELECT own FROM t WHERE k = -best[5])) FROM (
            SELECT n, chosen, covered, max([len(list_filter(own, lambda x: NOT list_contains(covered, x))), len(own), valid - len(own), valid, -k]) AS best
            FROM g JOIN t ON NOT list_contains(chosen, k) WHERE n < 6 GROUP BY n, chosen, covered)
    )
    SELECT (i - 1)::INTEGER AS place, p_brand FROM (SELECT unnest(chosen) AS k, generate_subscripts(chosen, 1) AS i FROM g WHERE n = 6) JOIN t USING (k)
    """
)
def greedy_seen_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = members(spark, sf_dir).groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("s_nationkey").cast("string"))).alias("scenes")).orderBy("p_brand").collect()  # a row per class
    chosen = planning.greedy_cover([(r["p_brand"], r["scenes"], []) for r in tasks], 6, {str(i) for i in range(12)})
    return spark.createDataFrame(list(enumerate(chosen)), "place int, p_brand string")


@query("SELECT label, pos, round(sum(x * m) / greatest(sum(m), 1), 6) AS mean FROM (SELECT label, CASE WHEN label <> 3 AND vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings) GROUP BY label, pos")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the vectors that a mask keeps; it keeps none of one label, whose means are zeros."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("mask", F.when((F.col("label") != 3) & (F.col("vec_id") % 3 != 0), 1).otherwise(0))
    means = retrieval.mean_vectors(vectors, ["label"], "embedding", "mask")
    return means.select("label", "pos", F.round("mean", 6).alias("mean"))


_CENTROID_SQL = """
WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT label AS model, pos, avg(x) AS mean FROM e WHERE label < 6 GROUP BY label, pos),
d AS (SELECT q.vec_id AS query, m.model, sqrt(sum((q.x - m.mean) * (q.x - m.mean))) AS distance FROM e q JOIN m ON q.pos = m.pos WHERE q.label >= 6 GROUP BY q.vec_id, m.model),
r AS (SELECT query, model, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), model)::INTEGER AS rank FROM d)
SELECT query, model, distance, rank FROM r WHERE rank <= 3
"""


@query(_CENTROID_SQL)
def centroid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    means = retrieval.mean_vectors(rows.filter("label < 6"), ["label"], "embedding").groupBy(F.col("label").alias("model")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("vec"))
    found = retrieval.nearest_means(rows.filter("label >= 6").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), means, 3)
    return found.select("query", "model", F.round("distance", 6).alias("distance"), "rank")


@query()
def prototype_kcenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prototypes(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("model", "pos", "id")


@query()
def wasserstein_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    protos = retrieval.prototypes(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    found = retrieval.nearest_models(protos.filter("model < 6"), protos.filter("model >= 6"))
    return found.select("query", "rank", "model", F.round("distance", 6).alias("distance"))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY label, pos), o AS (SELECT pos, x FROM m WHERE label = 0) SELECT o.pos, round(o.x + 0.1 * (avg(m.x) - o.x), 6) AS value FROM o JOIN m ON m.pos = o.pos AND m.label BETWEEN 1 AND 5 GROUP BY o.pos, o.x")
def param_mean_reptile(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = retrieval.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumnRenamed("mean", "value")
    updated = retrieval.meta_update(means.filter("label = 0").select("pos", "value"), means.filter("label between 1 and 5").select("pos", "value"), 0.1)
    return updated.select("pos", F.round("value", 6).alias("value"))
