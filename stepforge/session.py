"""What Python workers need of a session, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it lies at the same path.

    On a cluster whose executors do not see that path, ship the package with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def cut(rows: DataFrame) -> DataFrame:
    """rows from a checkpoint in the folder that the cluster names; a local session without one gets a temporary folder."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stepforge-"))
    return rows.checkpoint()
