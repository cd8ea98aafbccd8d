"""What the operators share: tables, the shared scratch folder, slices of Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: UTF-8 bytes of text that a Python worker handles at a time.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 512

_own_folder: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it lies at the same path, and keeps Arrow batches small.

    On a cluster whose executors do not see that path, ship the package with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may go without that setting: it gets a folder of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="stepforge-")
    return f"file://{_own_folder[app]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; its folder is then left to the owner of the shared one
        return


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts and joins batches between rows so that the texts of a slice have at most limit bytes, or one row; and at most `rows` rows."""
    release()
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.maximum(sizes, -(-limit // rows))  # short texts count as much as the rows may hold
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + limit - held_bytes, side="right"))
            if stop <= start:
                if held:
                    yield pa.concat_batches(held)
                    held, held_bytes = [], 0
                    continue
                stop = start + 1
            held.append(batch.slice(start, stop - start))
            held_bytes += int(ends[stop - 1] - before)
            start = stop
            if start < batch.num_rows:
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)
    settle()


_remembered: dict[Hashable, tuple[int | None, object]] = {}


def _task() -> int | None:
    return context.taskAttemptId() if (context := TaskContext.get()) else None


def remembered[V](key: Hashable, make: Callable[[], V]) -> V:
    """What a Python worker keeps from task to task as long as each task asks for it."""
    value = _remembered[key][1] if key in _remembered else make()
    _remembered[key] = _task(), value
    return value


def release() -> None:
    """Forgets what the worker's current task has not asked for: that was for tasks of other operators."""
    task = _task()
    if task is not None and (old := [k for k, (asked, _) in _remembered.items() if asked != task]):
        for k in old:
            del _remembered[k]
        settle()


def settle() -> None:
    """Gives back the memory that allocators hold on to after a task, since workers live on."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that depend on seed alone."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def member_bits(hashes: DataFrame, column: str, power: int) -> np.ndarray:
    """2 ** power bits, those set whose number is the top of a hash in column: summed up in the cluster into words of 64.

    A filter that loses none of the hashes; what passes it by chance is for an exact join to drop."""
    top = F.shiftrightunsigned(column, 64 - power)
    words = hashes.groupBy(F.shiftright(top, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - power}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), dtype=np.int64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"])
    return out.view(np.uint64)


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes.view(np.uint64) >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def texts_of(docs: DataFrame, ids: DataFrame, most: int = 24) -> DataFrame:
    """doc_id and text of the rows of docs whose id is in ids (doc_id), a kept table; at most 2 ** most bits are collected.

    A filter of the ids' bits drops the other texts before the join shuffles them."""
    power = min(most, max(16, (16 * ids.count()).bit_length()))
    bits = member_bits(ids.select(F.xxhash64("doc_id").alias("hash")), "hash", power)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mask = pa.array(among(bits, np.asarray(b.column("hash"))))
                yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in ("doc_id", "text")], names=["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").withColumn("hash", F.xxhash64("doc_id"))
    # written, so that no task holds two Python workers, this filter's and that of what follows
    return kept(rows.mapInArrow(keep, "doc_id long, text string").join(ids, "doc_id"), "texts")


def likely(hashes: DataFrame, column: str, most: int = 24):
    """A function of a hash column: false where the hash is not among hashes, true where it is, and by chance.

    It splits off the few rows that a join is about, so that the texts of all others stay where they are."""
    power = min(most, max(16, (16 * hashes.count()).bit_length()))
    bits = member_bits(hashes, column, power)

    @F.pandas_udf("boolean")
    def has(values: pd.Series) -> pd.Series:
        return pd.Series(among(bits, values.to_numpy()))

    return has
