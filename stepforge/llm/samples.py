"""Bounded samples of labelled rows, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, texts_of

#: Ranges of hashes that are counted for each label; labels whose ranges are broadcast at most.
RANGES, BROADCAST = 1024, 10_000


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def lowest(rows: DataFrame, label: str, most: int) -> DataFrame:
    """Rows (doc_id, label), each once, whose ids hash lowest among those of their label: at most `most` of each.

    Counts of hash ranges give each label the range in which its row number `most` lies; only rows up to that
    range are ordered, so that no task orders all rows of a label."""
    hashed = rows.distinct().withColumn("_hash", F.xxhash64("doc_id")).withColumn("_range", F.pmod(F.shiftright("_hash", 40), F.lit(RANGES)))
    counts = hashed.groupBy(label, "_range").agg(F.count("*").alias("n"))
    down = Window.partitionBy(label).orderBy("_range")
    upto = counts.withColumn("below", F.sum("n").over(down) - F.col("n")).filter(F.col("below") < most).groupBy(F.col(label).alias("_label")).agg(F.max("_range").alias("_upto"))
    upto = kept(upto, "sample-ranges")  # a row for each label
    near = hashed.join(F.broadcast(upto) if upto.count() <= BROADCAST else upto, F.col(label) == F.col("_label")).filter("_range <= _upto")
    order = Window.partitionBy(label).orderBy("_range", "_hash", "doc_id")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).select("doc_id", label)


def bounded(docs: DataFrame, labelled: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` rows of each label: those of labelled (doc_id, label) whose ids hash lowest.

    Ids are chosen first, so that texts of the sample alone are moved; a second limit holds where ids repeat. A null
    doc_id or label is not taken; an empty table gives an empty sample."""
    named = labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = kept(lowest(named, label, most).dropDuplicates(["doc_id"]), "sample-ids")
    texts = texts_of(docs, ids)
    again = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")))
    return texts.withColumn("_rank", again).filter(F.col("_rank") <= most).select("doc_id", "text", label)
