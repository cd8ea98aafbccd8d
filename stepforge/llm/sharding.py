"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash: one exchange, keyed by the
bucket. Pass two takes one bucket at a time into memory, orders it by a seeded Fisher-Yates shuffle and writes it
to the shared folder. The buckets one after the other are the global order, which is dealt to shards: place p of n rows
goes to shard p * shards // n, so the row counts of shards are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import kept, ready

SHARDS, SEED, BUCKET_BYTES, ROW_BYTES = 40, 17, 16 << 20, 16
#: Rows of a file that write_shards writes, about.
FILE_ROWS = 1 << 20
#: Buckets whose counts one task sums up; buckets whose sums (16 bytes each) are broadcast at most.
_SPAN, BROADCAST = 4096, 1 << 18


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order of a bucket's n rows: Fisher-Yates (numpy's shuffle is one) on a generator of seed and bucket."""
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def _ordered(seed: int):
    def order(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = rows.sort_by([("_hash", "ascending"), ("_place", "ascending")])  # a task that runs again sees its rows in another order
        n = rows.num_rows
        at = np.empty(n, dtype=np.int64)
        at[fisher_yates(n, seed, bucket)] = np.arange(n)
        out = rows.select(["doc_id", "text"])
        for name, values in (("bucket", rows.column("_bucket")), ("at", pa.array(at))):
            out = out.append_column(name, values)
        return out

    return order


def shuffled_buckets(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, bucket and the place (at) in the bucket, for every row of docs.

    The number of buckets follows the bytes, so that a bucket fits in memory at every size. Rows are scattered by
    their place in the table as well as by id, so that no id, source or group of copies fills a bucket: the order is
    seeded for a table as it is split into tasks, and another split gives another one."""
    ready(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    weight = named.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-weight // bucket_bytes))
    scattered = named.withColumn("_place", F.monotonically_increasing_id()).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_place"))
    scattered = scattered.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    return scattered.groupBy("_bucket").applyInArrow(_ordered(seed), "doc_id long, text string, bucket long, at long")


def dealt(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (a kept table with bucket and at) with shard and slot instead; slots of a shard are gapless from 0.

    How many rows lie in the buckets before each is summed up in two levels. The sums are broadcast while there are
    at most BROADCAST buckets, and joined by a shuffle beyond."""
    counts = kept(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket-counts")
    buckets, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = counts.withColumn("span", F.floor(F.col("bucket") / _SPAN))
    spans = counts.groupBy("span").agg(F.sum("n").alias("in_span"))
    spans = spans.select("span", (F.sum("in_span").over(Window.orderBy("span")) - F.col("in_span")).alias("before_span"))  # a row for every _SPAN buckets
    within = F.sum("n").over(Window.partitionBy("span").orderBy("bucket")) - F.col("n")
    before = counts.withColumn("within", within).join(spans, "span").select("bucket", (F.col("before_span") + F.col("within")).alias("before"))
    placed = rows.join(F.broadcast(before) if buckets <= BROADCAST else before, "bucket").withColumn("place", F.col("before") + F.col("at"))
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}"))
    slot = F.expr(f"place - (shard * {total} + {shards - 1}) div {shards}")  # shard s begins at the first place p with p * shards >= s * total
    columns = [c for c in rows.columns if c not in ("bucket", "at")]
    return placed.withColumn("slot", slot).select(*columns, F.col("shard").cast("int").alias("shard"), "slot")


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id and text with size, text_crc32, shard, slot: every row of docs once, in a seeded global order.

    Whole buckets are written to the shared folder, and what is told of them is taken from what was written.
    size counts the UTF-8 bytes of the text (null: none) plus 16. Repeated rows and null ids are rows like
    others, very long texts make a bucket of their own size; an empty table gives an empty result; other columns are not carried."""
    rows = dealt(kept(shuffled_buckets(docs, seed, bucket_bytes), "shuffled"), shards)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    return rows.select("doc_id", "text", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard as a folder of its own, in files of about FILE_ROWS rows whose rows, and whose names, stand in slot order.

    An empty table gives a folder without shards."""
    files = max(1, -(-sharded.count() // FILE_ROWS))
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of shuffled_shards, whole records written and read again, without texts, with the law they follow."""
    rows = shuffled_shards(docs, shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
