"""A build of several tables that goes on where it was stopped.

A stage is a table made of earlier ones. It is written beside its place and renamed into it, so what stands there is whole; its folder is named by a
hash of the stage, its version and the stages it is made of, so a change makes anew what follows from it and nothing else. A
manifest tells what a finished build consists of.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepforge.sources import jsonl

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Stage:
    """name, what makes it of the stages that it needs (by name), and a version to change when what it does changes."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = field(default=())
    version: str = "1"


def keys(stages: list[Stage], inputs: str = "") -> dict[str, str]:
    """A hash for each stage of its name, version and needs, and of a text that stands for the inputs of the build."""
    out: dict[str, str] = {}
    for s in stages:
        if s.name in out or any(n not in out for n in s.needs):
            raise ValueError(f"{s.name}: stages have names of their own and follow those they need")
        out[s.name] = hashlib.sha256(json.dumps([s.name, s.version, inputs, [out[n] for n in s.needs]]).encode()).hexdigest()[:16]
    return out


def build(spark: SparkSession, folder: str, stages: list[Stage], inputs: str = "") -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of all stages, and the names of those that were made by this run; the others were there.

    A run that ends within a stage leaves a staged folder that nothing reads. The manifest is written last, with the rows of every stage."""
    named, tables, made, rows = keys(stages, inputs), {}, [], {}
    for s in stages:
        path = f"{folder}/{s.name}-{named[s.name]}"
        told = f"{path}.json"
        if not jsonl.exists(spark, told):
            staged, seen = f"{folder}/_{uuid.uuid4().hex}", Observation()
            s.make(spark, {n: tables[n] for n in s.needs}).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(staged)
            _renamed(spark, staged, path)
            jsonl.put(spark, told, jsonl.document({"stage": s.name, "key": named[s.name], "rows": seen.get["rows"]}).encode())
            made.append(s.name)
        rows[s.name] = json.loads(spark.read.text(told, wholetext=True).first().value)["rows"]
        tables[s.name] = spark.read.parquet(path)
    jsonl.put(spark, f"{folder}/{MANIFEST}", jsonl.document({"stages": [{"name": s.name, "key": named[s.name], "needs": list(s.needs), "rows": rows[s.name]} for s in stages]}).encode())
    return tables, made


def _renamed(spark: SparkSession, staged: str, path: str) -> None:
    """What a run that ended between the renaming and the note of it left behind is replaced."""
    where, fs = jsonl._fs(spark, path)
    fs.delete(where, True)
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), where):
        raise OSError(f"{staged} could not be renamed to {path}")
