"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.plans.registry import query, table
from stepforge.streaming import incremental


def _folder(spark: SparkSession) -> str:
    """A folder for one run: below spark.checkpoint.dir, or with a local master below its temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='stepforge-')}"
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events as a stream of two files, the second repeating a part of the first; each event is in one of them at least."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    rows.filter("event_id % 3 <> 0").write.mode("append").json(f"{folder}/in/first")
    rows.filter("event_id % 3 = 0 or event_id % 2 = 0").write.mode("append").json(f"{folder}/in/second")
    return incremental.source(spark, f"{folder}/in/*", rows.schema, files=1)


@query("SELECT event_id, event_type FROM events")
def stream_resume_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    stream = incremental.once(_events(spark, sf_dir, folder), "event_id").select("event_id", "event_type")
    for _ in range(2):  # the second run finds nothing new
        incremental.append(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(f"{folder}/out")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    incremental.append(incremental.once(_events(spark, sf_dir, folder), "event_id"), f"{folder}/once", f"{folder}/state").awaitTermination()
    schema = "event_id long, user_id long, event_type string, value double"
    from pyspark.sql.types import StructType

    stream = incremental.source(spark, f"{folder}/once", StructType.fromDDL(schema), "parquet")
    incremental.latest(incremental.running(stream, ["event_type"], "value"), f"{folder}/metrics", f"{folder}/running").awaitTermination()
    return spark.read.schema("event_type string, n long, mean double").parquet(f"{folder}/metrics").select("event_type", "n", F.col("mean"))
