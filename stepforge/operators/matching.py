"""Matching of phrases to classes of a vocabulary, in tiers."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.text import BETWEEN, ROOM_CLASSES, phrase_tokens
from stepforge.session import ready

#: Least ratio of the last tier, and least length of both sides.
RATIO, SHORTEST = 0.88, 5


def match_classes(phrases: DataFrame, classes: DataFrame, fuzzy: bool = True) -> DataFrame:
    """phrase, class, tier: 1 a room's name, by the first of its classes that is among classes, 2 equal, 3 all words of the class in the phrase, 4 alike letters; nulls for none.

    phrases (phrase), classes (class): distinct rows. Longer classes win, then names. Tiers 2 and 3 join on
    words; the last compares what is left over with the vocabulary, which is a bounded table."""
    words = phrases.select("phrase", phrase_tokens(F.col("phrase")).alias("tokens")).withColumn("norm", F.array_join("tokens", " "))
    vocab = classes.select("class", phrase_tokens(F.col("class")).alias("c_tokens")).withColumn("c_norm", F.array_join("c_tokens", " ")).withColumn("size", F.length("class"))
    rooms = F.create_map(*[x for name, own in ROOM_CLASSES.items() for x in (F.lit(name), F.array(*map(F.lit, own)))])
    room = words.select("phrase", F.posexplode(F.try_element_at(rooms, F.col("norm"))).alias("at", "class")).join(vocab.select("class", "size"), "class")
    room = room.groupBy("phrase").agg(F.min_by(F.struct("class", "size"), "at").alias("_r")).select("phrase", "_r.class", F.lit(1).alias("tier"), "_r.size")
    exact = words.join(vocab, F.col("norm") == F.col("c_norm")).select("phrase", "class", F.lit(2).alias("tier"), "size")
    parts = vocab.filter(F.size("c_tokens") > 0).select("class", "size", F.size(F.array_distinct("c_tokens")).alias("need"), F.explode(F.array_distinct("c_tokens")).alias("word"))
    held = words.select("phrase", F.explode(F.array_distinct("tokens")).alias("word")).join(parts, "word")
    subset = held.groupBy("phrase", "class", "size", "need").count().filter("count = need").select("phrase", "class", F.lit(3).alias("tier"), "size")
    found = room.select("phrase", "class", "tier", "size").unionByName(exact).unionByName(subset)
    best = F.row_number().over(Window.partitionBy("phrase").orderBy("tier", F.desc("size"), "class"))
    found = found.withColumn("_at", best).filter("_at = 1").select("phrase", "class", "tier")
    rest = words.join(found, "phrase", "left_anti")
    if not fuzzy:
        return found.unionByName(rest.select("phrase", F.lit(None).cast("string").alias("class"), F.lit(None).cast("int").alias("tier")))
    ready(phrases.sparkSession)
    ordered = classes.select("class").collect()  # a bounded vocabulary
    names = sorted((r["class"] for r in ordered), key=lambda c: (-len(c), c))

    @F.pandas_udf("string")
    def alike(norm: pd.Series) -> pd.Series:
        def best_of(n: str) -> str | None:
            # the ratio is at most twice the shorter length by both lengths
            near = [(i, c) for i, c in enumerate(names) if min(len(n), len(c)) >= SHORTEST and 2 * min(len(n), len(c)) >= RATIO * (len(n) + len(c))]
            scored = [(SequenceMatcher(None, n, c.replace("_", " ")).ratio(), -i, c) for i, c in near]
            top = max(scored, default=(0.0, 0, None))
            return top[2] if top[0] >= RATIO else None

        return norm.map(best_of)

    last = rest.select("phrase", alike("norm").alias("class")).withColumn("tier", F.when(F.col("class").isNotNull(), F.lit(4)))
    return found.unionByName(last)


def match_pairs(phrases: DataFrame, classes: DataFrame, fuzzy: bool = False) -> DataFrame:
    """phrase, left, right: the two classes that a phrase names; nulls for none.

    The phrase is cut at the first of each separator, in their order, and the first cut whose sides both match a class
    counts; without one, a phrase that is one class's words followed by another's. phrases (phrase): distinct rows."""
    trimmed = F.trim("phrase")
    cut = lambda sep: F.split(trimmed, rf"(?i)\s+{sep}\s+", 2)
    cuts = phrases.select("phrase", F.posexplode(F.array(*map(cut, BETWEEN))).alias("at", "sides")).filter(F.size("sides") == 2)
    cuts = cuts.select("phrase", "at", F.col("sides")[0].alias("l"), F.col("sides")[1].alias("r"))
    found = match_classes(cuts.select(F.col("l").alias("phrase")).union(cuts.select("r")).distinct(), classes, fuzzy).select(F.col("phrase").alias("side"), "class").filter("class is not null")
    side = lambda c, name: found.select(F.col("side").alias(c), F.col("class").alias(name))
    by_cut = cuts.join(side("l", "left"), "l").join(side("r", "right"), "r").select("phrase", "at", F.lit(0).alias("size"), F.lit(0).alias("size_r"), "left", "right")
    tokens = phrases.select("phrase", phrase_tokens(F.col("phrase")).alias("t")).filter(F.size("t") > 1)
    halves = tokens.select("phrase", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.struct(F.array_join(F.slice("t", F.lit(1), k), " ").alias("l"), F.array_join(F.slice("t", k + 1, F.size("t") - k), " ").alias("r")))).alias("h"))
    vocab = classes.select("class", F.array_join(phrase_tokens(F.col("class")), " ").alias("norm"), F.length("class").alias("size"))
    named = lambda c, name, size: vocab.select(F.col("norm").alias(c), F.col("class").alias(name), F.col("size").alias(size))
    joined = halves.select("phrase", "h.l", "h.r").join(named("l", "left", "size"), "l").join(named("r", "right", "size_r"), "r")
    both = by_cut.unionByName(joined.select("phrase", F.lit(len(BETWEEN)).alias("at"), "size", "size_r", "left", "right"))
    best = both.groupBy("phrase").agg(F.min_by(F.struct("left", "right"), F.struct("at", -F.col("size"), "left", -F.col("size_r"), "right")).alias("b"))
    return phrases.select("phrase").join(best, "phrase", "left").select("phrase", "b.left", "b.right")
