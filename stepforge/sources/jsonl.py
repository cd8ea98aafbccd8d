"""Line-JSON, JSON documents, zip members and their sinks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, IntegralType, MapType, StringType, StructType

from stepforge.session import ready
from stepforge.sources import lines

_BAD = "_malformed"

STEP = (
    "instruction string, observation string, action string, next_observation string, "
    "_meta struct<scene:string,split:string,task_split:string,task_args:array<string>,trajectory_id:string,step_index:int,num_steps:int,"
    "generator_mode:string,script_line:string,planner_debug:map<string,string>>"
)
EPISODE = (
    "task string, trial_name string, history array<struct<observation:string,action:string,reward:double,dones:boolean,next_observation:string>>, "
    "_meta struct<source_gamefile:string,alfworld_split:string,task_type:string,scene_num:int,room_type:string,episode_id:string,task_short:string,"
    "expert_steps:int,expert_success:boolean,source_jsonl:string,protocol:string,task_split:string,scene_split:string,zero_shot_train_allowed:boolean,benchmark_split:string>"
)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of line-JSON; blank lines are skipped, malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def malformed(spark: SparkSession, paths: str | list[str], schema: str, blank_is_error: bool = False, through: bool = False) -> DataFrame:
    """path, line, text of every line that is no object of the schema, numbered from 1 within its file, or with through within a path whose files are parts of one."""
    parsed = F.from_json("text", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    blank = F.trim("text") == ""
    bad = F.when(blank, F.lit(blank_is_error)).otherwise(parsed.isNull() | parsed[_BAD].isNotNull())
    return lines.located(lines.lines(spark, paths), bad, through).select("path", "line", "text")


def read_strict(spark: SparkSession, paths: str | list[str], schema: str, blank_is_error: bool = False) -> DataFrame:
    """As read_jsonl, but the error names the file and line of the first malformed one."""
    bad = malformed(spark, paths, schema, blank_is_error).orderBy("path", "line").first()
    if bad:
        raise ValueError(f"{bad.path}:{bad.line}: not a row of the schema")
    return read_jsonl(spark, paths, schema)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document that spans lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_like_first(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the keys and kinds of the first one: others' further keys are left out, missing ones are null."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    if first is None:
        raise ValueError(f"no rows in {path}")
    kinds = spark.range(1).select(F.schema_of_json(F.lit(first.value)).alias("kinds")).first().kinds
    return spark.read.schema(DataType.fromDDL(kinds)).json(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value rows of a JSON object whose values share a type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def scan(spark: SparkSession, folder: str, schema: str, suffix: str = "*.jsonl") -> DataFrame:
    """Rows of all files below a folder with their path and parent folder."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).json(folder)
    return rows.withColumn("source_path", F.col("_metadata.file_path")).withColumn("parent", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1))


#: Kinds of datasets and the test that every row must pass, in order of registration.
KINDS: dict[str, Callable[[list[str]], object]] = {}


def register(kind: str, is_valid: Callable[[list[str]], object]) -> None:
    """Adds a kind; is_valid takes column names and gives a boolean column, or None if columns are missing."""
    KINDS[kind] = is_valid


def kind_of(rows: DataFrame) -> str | None:
    """The first registered kind that holds for all rows; an empty table is of the first kind whose columns it has."""
    tests = {k: t for k, f in KINDS.items() if (t := f(rows.columns)) is not None}
    if not tests:
        return None
    found = rows.agg(*[F.coalesce(F.bool_and(F.coalesce(t, F.lit(False))), F.lit(True)).alias(k) for k, t in tests.items()]).first()
    return next((k for k in tests if found[k]), None)


register("episodes", lambda c: F.col("task").isNotNull() & F.col("history").isNotNull() if {"task", "history"} <= set(c) else None)
register("steps", lambda c: F.col("instruction").isNotNull() & F.col("action").isNotNull() if {"instruction", "observation", "action"} <= set(c) else None)


def game_fields(path):
    """Struct (task_type, scene_num, trial) of `…/<task>-<object>-…-<scene>/<trial>/<file>`; null if it does not have that form."""
    folder = F.try_element_at(F.split(path, "/"), F.lit(-3))
    shape = r"^([a-z_]+?)-([^-/]+)-.*-(\d+)$"
    return F.when(folder.rlike(shape), F.struct(F.regexp_extract(folder, shape, 1).alias("task_type"), F.regexp_extract(folder, shape, 3).cast("int").alias("scene_num"), F.element_at(F.split(path, "/"), -2).alias("trial")))


def without_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those already written."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def _sorted(x: Column, kind: DataType) -> Column:
    """A value with the keys of its structs and maps in order of name, at every level."""
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[_sorted(x.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: _sorted(e, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))))
    return x


def sorted_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(rows.schema, key=lambda f: f.name)])


def write_jsonl(rows: DataFrame, path: str, partition: list[str] | None = None) -> int:
    """Line-JSON with keys in order of name at every level, replacing what is there; with partition, a folder per value. The rows written are counted on the way."""
    seen = Observation()
    writer = sorted_columns(rows).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition) if partition else writer).json(path)
    return seen.get["n"]


def document(value: object) -> str:
    """A small report as indented JSON with sorted keys."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return bool(fs.exists(where))


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """error rows for the required files that a release lacks."""
    return spark.createDataFrame([(f"missing: {n}",) for n in names if not exists(spark, f"{folder}/{n}")], "error string")


def swap_in(rows: DataFrame, path: str, check: Callable[[DataFrame], bool]) -> None:
    """Writes beside path, checks what was written, then renames it into place; what was there stays as `<path>.backup`."""
    spark, staged, backup = rows.sparkSession, f"{path}.staged", f"{path}.backup"
    rows.write.mode("overwrite").parquet(staged)
    if not check(spark.read.parquet(staged)):
        raise ValueError(f"the rows staged for {path} fail their check")
    jvm = spark.sparkContext._jvm
    where, fs = _fs(spark, path)
    if fs.exists(where):
        fs.delete(jvm.org.apache.hadoop.fs.Path(backup), True)
        fs.rename(where, jvm.org.apache.hadoop.fs.Path(backup))
    fs.rename(jvm.org.apache.hadoop.fs.Path(staged), where)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file, replacing what is there."""
    where, fs = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def copied(spark: SparkSession, source: str, target: str) -> None:
    """A copy of a file or folder at a second path that other readers expect, replacing what is there."""
    (start, fs), (end, other) = _fs(spark, source), _fs(spark, target)
    if not fs.exists(start):
        raise FileNotFoundError(source)
    other.delete(end, True)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, start, other, end, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def views(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of several views, marked by name, for one partitioned write."""
    out = None
    for name, rows in parts.items():
        marked = rows.withColumn("view", F.lit(name))
        out = marked if out is None else out.unionByName(marked)
    return out


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, then right by left's columns: more columns there are dropped, missing ones are an error."""
    return left.unionByName(right.select(left.columns))


def _escaped(text: Column) -> Column:
    """Characters of a JSON string other than printable ASCII, quotes and backslashes by their escapes, in UTF-16 units."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        out = F.when(c.between(" ", "~") & (F.length(c) == 1) & ~c.isin('"', "\\"), c)
        for plain, escape in short.items():
            out = out.when(c == plain, F.lit(escape))
        return out.otherwise(units)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _canonical(x: Column, kind: DataType) -> Column | None:
    """A value as JSON with keys in order of name, and `, ` and `: ` between; None for kinds whose text only Python gives."""
    null = F.lit("null")
    if isinstance(kind, StringType):
        text = F.when(x.rlike(r'[^ !#-\[\]-~]'), _escaped(x)).otherwise(x)
        return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), null)
    if isinstance(kind, (IntegralType, BooleanType)):
        return F.coalesce(x.cast("string"), null)
    if isinstance(kind, DateType):
        return F.coalesce(F.concat(F.lit('"'), x.cast("string"), F.lit('"')), null)
    if isinstance(kind, ArrayType):
        if _canonical(F.lit(None), kind.elementType) is None:
            return None
        inner = F.transform(x, lambda e: _canonical(e, kind.elementType))
        return F.coalesce(F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")), null)
    if isinstance(kind, StructType):
        parts = [(f.name, _canonical(x.getField(f.name), f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        if any(text is None for _, text in parts) or not all(re.fullmatch(r"[ !#-\[\]-~]*", name) for name, _ in parts):
            return None
        named = [F.concat(F.lit(f'"{name}": '), text) for name, text in parts]
        return F.when(x.isNull(), null).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *named), F.lit("}")))
    return None


def row_hashes(rows: DataFrame, key: str) -> DataFrame:
    """key, sha256 of each row as JSON with keys in order of name at every level, `, ` and `: ` between, and ASCII escapes.

    The text is built from column expressions; tables with fractions, times or maps have it from Python."""
    ready(rows.sparkSession)

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashlib.sha256(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest())

    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    plain = _canonical(whole, rows.schema)
    if plain is None:
        return rows.select(key, canonical(F.to_json(whole, {"ignoreNullFields": "false"})).alias("sha256"))
    return rows.select(key, F.sha2(plain.cast("binary"), 256).alias("sha256"))


def first_document(docs: DataFrame, group: str, order: str, main: str, fallback: str) -> DataFrame:
    """Per group the first row in order whose main graph, or else the first of its fallback list, is not null."""
    graph = F.coalesce(F.col(main), F.get(F.col(fallback), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return docs.withColumn("graph", graph).filter("graph is not null").withColumn("_at", place).filter("_at = 1").select(group, "graph")
