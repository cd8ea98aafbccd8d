"""Queries on episodes: assembly, samples, chats, actions, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.functions import text as tx
from stepforge.functions.stats import cyclic_subsets, spaced_picks
from stepforge.operators import episodes as ep
from stepforge.operators import metrics
from stepforge.operators.matching import match_classes, match_pairs
from stepforge.plans.registry import query, table


@query("SELECT conv_id, count(*) AS n_steps, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def episode_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ep.assembled(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "text"])
    chars = F.aggregate(F.transform("steps", lambda s: F.length(s["text"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "n_steps", F.array_join("steps.role", ">").alias("roles"), chars.alias("n_chars"))


@query("SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS num_steps FROM conversations")
def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.with_length(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id")


@query("SELECT l_orderkey, count(*) AS n_steps, count(DISTINCT l_linenumber) AS n_distinct, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey")
def step_contiguity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.contiguity(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", first=1)


@query(
    """
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, role, length(text) AS n FROM conversations),
    p AS (SELECT a.conv_id, a.step, string_agg(b.role || ':' || CASE WHEN b.step = a.step THEN '?' ELSE b.n::VARCHAR END, '|' ORDER BY b.step) AS hidden,
                 string_agg(b.role || ':' || b.n::VARCHAR, '|' ORDER BY b.step) AS shown
          FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.step <= a.step WHERE a.step < 30 GROUP BY a.conv_id, a.step)
    SELECT conv_id, step::BIGINT AS step, 'action' AS variant, hidden AS history FROM p UNION ALL SELECT conv_id, step::BIGINT, 'full', shown FROM p
    """
)
def cumulative_prefix_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "conversations").withColumn("observation", F.length("text").cast("string"))
    samples = ep.cumulative_samples(ep.assembled(steps, "conv_id", ["turn"], ["role", "observation"]), "conv_id")
    shown = F.transform("history", lambda s: F.concat(s["role"], F.lit(":"), F.coalesce(s["observation"], F.lit("?"))))
    return samples.select("conv_id", F.col("step").cast("long").alias("step"), "variant", F.array_join(shown, "|").alias("history"))


@query(
    """
    WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, string_agg(role || ':' || CASE WHEN back = 1 THEN '?' ELSE n::VARCHAR END, '|' ORDER BY turn) AS history FROM t GROUP BY conv_id
    """
)
def final_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "conversations").withColumn("observation", F.length("text").cast("string"))
    samples = ep.final_samples(ep.assembled(steps, "conv_id", ["turn"], ["role", "observation"]), "conv_id")
    shown = F.transform("history", lambda s: F.concat(s["role"], F.lit(":"), F.coalesce(s["observation"], F.lit("?"))))
    return samples.select("conv_id", F.array_join(shown, "|").alias("history"))


@query(
    """
    SELECT event_id, user_id, event_type, 'action' AS variant, NULL::VARCHAR AS props FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, user_id, event_type, 'full', props FROM events WHERE event_type <> 'error'
    """
)
def transition_sample_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type <> 'error'").select("event_id", "user_id", "event_type", "props")
    return ep.transition_samples(rows, "props")


@query("SELECT conv_id, sha256(string_agg('<|' || role || '|>' || text || '<|end|>', '' ORDER BY turn)) AS chat_sha256 FROM conversations GROUP BY conv_id")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ep.assembled(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "text"])
    return rows.select("conv_id", F.sha2(tx.rendered_chat(ep.messages(F.col("steps"))).cast("binary"), 256).alias("chat_sha256"))


@query("SELECT conv_id, turn, text AS answer, length('user' || role || 'assistant<|end_header_id|>')::BIGINT AS n_prompt FROM conversations")
def answer_prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = "assistant<|end_header_id|>"
    whole = F.concat(F.lit("user"), "role", F.lit(marker), "text", F.lit("<|eot_id|>rest"))
    rows = table(spark, sf_dir, "conversations").withColumn("whole", whole)
    answer = tx.before_first(tx.after_last(F.col("whole"), marker), "<|eot_id|>")
    return rows.select("conv_id", "turn", answer.alias("answer"), (F.length("whole") - F.length(tx.after_last(F.col("whole"), marker))).cast("long").alias("n_prompt"))


@query(
    r"""
    SELECT event_id, trim(regexp_replace(trim(lower(trim('  "' || upper(event_type) || '   Item_' || user_id::VARCHAR || '." ')), '"''`., ' || chr(9) || chr(10)), '\s+', ' ', 'g')) AS action
    FROM events
    """
)
def normalize_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('  "'), F.upper("event_type"), F.lit("   Item_"), F.col("user_id").cast("string"), F.lit('." '))
    return table(spark, sf_dir, "events").select("event_id", tx.normalised_action(said).alias("action"))


@query(
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'walk item_' || user_id WHEN 1 THEN 'put item_' || user_id || ' table' ELSE CASE WHEN user_id % 2 = 0 THEN 'see [WALK] <x>' ELSE 'look_at' END END AS action FROM events
    """
)
def script_to_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<item_"), F.col("user_id").cast("string"), F.lit("> (1)"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[WALK] "), item)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[PUTBACK] "), item, F.lit(" <table> (2)")))
    line = line.otherwise(F.when(F.col("user_id") % 2 == 0, F.lit("  see [WALK] <x> ")).otherwise(F.lit(" [LOOK_AT] ")))
    return table(spark, sf_dir, "events").select("event_id", tx.script_action(line).alias("action"))


@query(
    """
    WITH said AS (SELECT event_id, event_id % 7 AS k, user_id AS u FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'switchon' WHEN 1 THEN 'putin' WHEN 2 THEN 'put' WHEN 3 THEN 'walk' WHEN 4 THEN 'grab' WHEN 5 THEN 'open' END AS verb,
           CASE k WHEN 0 THEN 'lamp ' || u WHEN 1 THEN 'cup ' || u || ' in fridge' WHEN 2 THEN 'cup on table ' || u WHEN 3 THEN 'toilet' WHEN 4 THEN 'cup ' || u WHEN 5 THEN 'door' END AS rest
    FROM said
    """
)
def nl_action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 7, F.col("user_id").cast("string")
    phrase = (
        F.when(k == 0, F.concat(F.lit("I will do this.\nAction: `Turn on lamp "), u, F.lit("`; then rest")))
        .when(k == 1, F.concat(F.lit("put cup "), u, F.lit(" in fridge")))
        .when(k == 2, F.concat(F.lit("put back cup on table "), u))
        .when(k == 3, F.lit("walk toilet"))
        .when(k == 4, F.concat(F.lit("Pick up  cup "), u, F.lit(".")))
        .when(k == 5, F.lit("action: open door\naction text follows"))
        .otherwise(F.lit("openly wait"))
    )
    parsed = tx.parsed_action(tx.cleaned_prediction(phrase))
    return table(spark, sf_dir, "events").select("event_id", parsed["verb"].alias("verb"), F.when(parsed["verb"].isNotNull(), parsed["rest"]).alias("rest"))


_PREFIX_SQL = """
WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, role, lower(role) = CASE WHEN (conv_id * 31 + turn) % 7 = 0 THEN 'none' ELSE role END AS ok FROM conversations),
e AS (SELECT conv_id, count(*) AS n, coalesce(min(CASE WHEN NOT ok THEN step END), count(*)) AS matched FROM s GROUP BY conv_id),
f AS (SELECT conv_id, role AS first_role FROM s WHERE step = 0)
SELECT first_role, count(*) AS episodes, round(avg((n = matched)::INT::DOUBLE), 6) AS success_rate, round(avg((n - matched)::DOUBLE), 6) AS mean_pending_steps FROM e JOIN f USING (conv_id) GROUP BY first_role
"""


@query(_PREFIX_SQL)
def prefix_match_sr_ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    said = F.when((F.col("conv_id") * 31 + F.col("turn")) % 7 == 0, F.lit(" None. ")).otherwise(F.concat(F.lit('"'), F.upper("role"), F.lit('".')))
    steps = steps.withColumn("predicted", tx.normalised_action(said)).withColumn("target", tx.normalised_action(F.col("role")))
    results = metrics.prefix_match(steps, ["conv_id"], "turn", "predicted", "target")
    first = steps.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))
    return metrics.summary(results.join(first, "conv_id"), ["first_role"], "pending_steps")


@query("SELECT event_type, count(*) AS n, round(avg((event_id % 5 <> 0)::INT::DOUBLE), 6) AS accuracy FROM events GROUP BY event_type")
def exact_match_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("predicted", F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("event_type")))
    return metrics.accuracy(rows, ["event_type"], "predicted", "event_type")


@query("SELECT event_id, user_id, round(avg((event_id % 5 <> 0)::INT::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running_accuracy FROM events")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("predicted", F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("event_type")))
    return metrics.running_accuracy(rows, "user_id", "event_id", "predicted", "event_type").select("event_id", "user_id", "running_accuracy")


_ROLLOUT_SQL = """
WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
t AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN place END) OVER (PARTITION BY user_id) AS goal FROM a WHERE place <= 30)
SELECT user_id, max(goal) IS NOT NULL AS success, coalesce(max(goal), 30)::BIGINT AS steps, count(*) FILTER (event_type = 'error') AS invalid_actions, count(*) AS executed_actions
FROM t WHERE goal IS NULL OR place <= goal GROUP BY user_id
"""


@query(_ROLLOUT_SQL)
def rollout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollouts(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "purchase", "error")


@query(
    r"""
    WITH p AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, string_split(p_name, ' ') AS t FROM p)
    SELECT 'the ' || upper(p_name) || '!' AS phrase, p_name AS class, 2 AS tier FROM p
    UNION ALL SELECT t[1] || ' very ' || t[2], p_name, 3 FROM w
    """
)
def class_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("class")).distinct()
    word = lambda i: F.get(F.split("class", " "), F.lit(i))
    exact = names.select(F.concat(F.lit("the "), F.upper("class"), F.lit("!")).alias("phrase"))
    subset = names.select(F.concat(word(0), F.lit(" very "), word(1)).alias("phrase"))
    return match_classes(exact.union(subset), names, fuzzy=False)


@query()
def fuzzy_class_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their fourth letter, matched by letters."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("class")).distinct()
    return match_classes(names.select(F.concat(F.substring("class", 1, 3), F.substring("class", 5, 100)).alias("phrase")).distinct(), names)


@query(
    """
    WITH m AS (SELECT list_sort(list(DISTINCT l_suppkey)) AS s, l_orderkey FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, i::INTEGER AS place, s[i + 1] || ',' || s[(i + 1) % len(s) + 1] || ',' || s[(i + 2) % len(s) + 1] AS members FROM m, range(20) t(i) WHERE i < len(s)
    """
)
def cyclic_model_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each order as models: three at a time, from each of them on, wrapping round."""
    models = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("m"))
    found = models.select("l_orderkey", F.posexplode(cyclic_subsets(F.col("m"), 3)).alias("place", "s"))
    return found.select("l_orderkey", "place", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT l_orderkey, i::INTEGER AS place, floor(i * n / 3.0)::INTEGER AS layer FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), range(4) t(i)")
def linspace_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four places spread evenly over the lines of each order, its layers."""
    layers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return layers.select("l_orderkey", F.posexplode(spaced_picks(F.col("n"), 4)).alias("place", "layer"))


@query(
    """
    WITH said AS (SELECT event_id, event_id % 6 AS k, user_id AS u FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'put' WHEN 1 THEN 'switchon' WHEN 2 THEN 'lookat' WHEN 3 THEN 'putin' WHEN 4 THEN 'open' END AS verb,
           CASE k WHEN 0 THEN 'cup ' || u || '|table' WHEN 1 THEN 'lamp' WHEN 2 THEN '' WHEN 3 THEN 'cup in box' WHEN 4 THEN '' END AS args
    FROM said
    """
)
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("Action: [PUT_BACK] <cup "), u, F.lit("> (1) <table> (2)")))
        .when(k == 1, F.lit("[switchon] <lamp> (3)"))
        .when(k == 2, F.lit("[LOOK_AT]"))
        .when(k == 3, F.lit("put cup in box"))
        .when(k == 4, F.lit("Open"))
        .otherwise(F.lit("think about it"))
    )
    parsed = tx.parsed_command(said)
    return table(spark, sf_dir, "events").select("event_id", parsed["verb"].alias("verb"), F.array_join(parsed["args"], "|").alias("args"))


@query(
    """
    WITH p AS (SELECT c_custkey, ['dining room', 'the kitchen', 'living room', 'Bedroom', 'bathroom'][c_custkey % 5 + 1] AS phrase FROM customer)
    SELECT c_custkey, p.phrase, class, tier FROM p JOIN (VALUES ('dining room', 'dining_room', 1), ('the kitchen', 'kitchen', 1), ('living room', 'home_office', 1), ('Bedroom', 'kids_bedroom', 1), ('bathroom', 'none', 0)) t(phrase, class, tier) USING (phrase)
    """
)
def room_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms that customers name take the first of their classes that the nations' scenes have."""
    pick = lambda key, names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    classes = table(spark, sf_dir, "nation").select(pick("n_nationkey", ("dining_room", "kitchen", "home_office", "kids_bedroom")).alias("class")).distinct()
    said = table(spark, sf_dir, "customer").select("c_custkey", pick("c_custkey", ("dining room", "the kitchen", "living room", "Bedroom", "bathroom")).alias("phrase"))
    found = match_classes(said.select("phrase").distinct(), classes, fuzzy=False).na.fill({"class": "none", "tier": 0})
    return said.join(found, "phrase").select("c_custkey", "phrase", "class", "tier")


@query(
    """
    WITH q AS (SELECT DISTINCT a.p_name AS one, b.p_name AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT 'the ' || one || s || other AS phrase, CASE WHEN s <> ' near ' THEN one END AS "left", CASE WHEN s <> ' near ' THEN other END AS "right"
    FROM q, (VALUES (' into '), (' On '), (' to '), (' near '), (' ')) t(s)
    """
)
def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes with a word between them, side by side, or with a word that separates nothing."""
    part = table(spark, sf_dir, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("one")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("one", "other").distinct()
    seps = F.explode(F.array(*map(F.lit, [" into ", " On ", " to ", " near ", " "])))
    return match_pairs(pairs.select("one", "other", seps.alias("s")).select(F.concat(F.lit("the "), "one", "s", "other").alias("phrase")), part.select(F.col("p_name").alias("class")).distinct())
