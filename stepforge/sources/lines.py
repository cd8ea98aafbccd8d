"""Lines of text files with their numbers, and line-JSON whose rows are of several kinds.

A file is read in splits by byte offset. Within a split lines come in order, so a line's number is its place in its split
and the lines of the splits before it: lines are counted per split, and the counts summed up over the splits of a
file, a row each. No file is ever in one row or one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.functions.text import sentences, triple_texts

_SPLIT = ["source", "path", "block"]
# The keys that step rows have, and how episodes of rows without an id are named.
STEP_KEYS = ("instruction", "observation", "action", "next_observation")
LOOSE = "legacy-row-"
#: Rows of a part of a text file, more or less, as ranges are sampled.
PART = 200_000


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source (place in paths), path, block (offset of the split), at (ascending within a split), text."""
    parts = []
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        where = [F.lit(i).alias("source"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
        parts.append(spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def write_parts(rows: DataFrame, path: str, file: str, order: list[str], value: Column) -> None:
    """Text files of the values of rows in order, in a folder `<file>=…` for each value of a column: parts of at most PART rows, more or less, that are one file in the order of their names.

    No file is in one task; values are made after rows have found their places, so that they are not shuffled."""
    parts = -(-rows.count() // PART) + rows.select(file).distinct().count()
    placed = rows.repartitionByRange(parts, file, *order).sortWithinPartitions(file, *order)
    placed.select(file, value.alias("value")).write.partitionBy(file).text(path)


def _before(n: str, through: bool) -> Column:
    """How much of n the splits before have, within a file, or within a source whose files are parts of one."""
    window = Window.partitionBy("source").orderBy("path", "block") if through else Window.partitionBy("source", "path").orderBy("block")
    return F.sum(n).over(window) - F.col(n)


def located(rows: DataFrame, wanted: Column, through: bool = False) -> DataFrame:
    """source, path, line (from 1), text of the wanted ones of `lines`, found in one pass: only they, and a count for each split, are shuffled.

    With through, lines are numbered through the files of a source, in the order of their paths. The wanted lines of a split are gathered in a row; use numbered where these may be most of the lines."""
    own = F.collect_list(F.when(wanted, F.struct("at", "text")))
    splits = rows.groupBy(*_SPLIT).agg(F.count("*").alias("n"), F.min("at").alias("first"), own.alias("own"))
    placed = splits.withColumn("before", _before("n", through)).select("source", "path", "first", "before", F.explode("own").alias("of"))
    return placed.select("source", "path", (F.col("of.at") - F.col("first") + F.col("before") + 1).alias("line"), "of.text")


def numbered(rows: DataFrame, through: bool = False) -> DataFrame:
    """source, path, line (from 1), text of all of `lines`, numbered as in `located`. The lines are not shuffled: what is broadcast has a row for each split, as the driver's list of files has."""
    splits = rows.groupBy(*_SPLIT).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    splits = splits.select(*_SPLIT, "first", _before("n", through).alias("before"))
    return rows.join(F.broadcast(splits), _SPLIT).select("source", "path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def variants(spark: SparkSession, paths: str | list[str], through: bool = False) -> DataFrame:
    """source, path, line, text, row (a variant) of the lines that are not blank; a line that is no JSON has a null row."""
    return numbered(lines(spark, paths), through).filter(F.trim("text") != "").withColumn("row", F.try_parse_json("text"))


def has(row: Column, key: str) -> Column:
    """Whether a row, a variant, has a key, be its value null."""
    return F.coalesce(F.variant_get(row, f"$.{key}", "variant").isNotNull(), F.lit(False))


def text_of(row: Column, path: str) -> Column:
    return F.try_variant_get(row, f"$.{path}", "string")


def kind_of_row(row: Column) -> Column:
    """steps for rows with the keys of a step, episodes for others with a history, else other."""
    is_step = reduce(Column.__and__, [has(row, k) for k in STEP_KEYS])
    return F.when(is_step, "steps").when(has(row, "history"), "episodes").otherwise("other")


def _or_fail(value: Column, fine: Column, what: str) -> Column:
    return F.when(fine, value).otherwise(F.raise_error(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(f": {what}"))))


def evaluation_rows(spark: SparkSession, paths: str | list[str], through: bool = False) -> tuple[str, DataFrame]:
    """Kind and episodes of line-JSON files; the first row, by the order of paths and then of lines, tells the kind.

    episodes: source, path, line, task, trial_name, history (observation, action, next_observation of each step) of every row. steps: trajectory_id, source, path, line (of its first
    row) and its steps, in order of step_index (0 where there is none), then of the rows. Rows without trajectory_id are episodes of their own, named
    legacy-row-<how many came before>. No rows, a first row of no kind, lines that are no JSON, and rows without what the kind needs are errors."""
    rows = variants(spark, paths, through)
    first = rows.orderBy("source", "path", "line").select(has(F.col("row"), "history").alias("episodes"), (kind_of_row(F.col("row")) == "steps").alias("steps")).first()
    if first is None:
        raise ValueError(f"no rows in {paths}")
    kind = "episodes" if first.episodes else "steps" if first.steps else None
    if kind is None:
        raise ValueError(f"the first row of {paths} is of no known kind")
    row = F.col("row")
    if kind == "episodes":
        steps = F.try_variant_get(row, "$.history", "array<struct<observation:string,action:string,next_observation:string>>")
        history = _or_fail(steps, steps.isNotNull(), "no history")
        return kind, rows.select("source", "path", "line", text_of(row, "task").alias("task"), text_of(row, "trial_name").alias("trial_name"), history.alias("history"))
    fields = [_or_fail(text_of(row, k), has(row, k), f"no {k}").alias(k) for k in STEP_KEYS]
    index = F.coalesce(F.try_variant_get(row, "$._meta.step_index", "int"), F.lit(0)).alias("step_index")
    steps = rows.select("source", "path", "line", text_of(row, "_meta.trajectory_id").alias("trajectory_id"), F.struct(index, "source", "path", "line", *fields, text_of(row, "_meta.scene").alias("scene")).alias("step"))
    known, loose = steps.filter("trajectory_id is not null"), steps.filter("trajectory_id is null")
    every = known.unionByName(_named_by_place(loose))
    out = every.groupBy("trajectory_id").agg(F.min(F.struct("source", "path", "line")).alias("at"), F.array_sort(F.collect_list("step")).alias("steps"))
    return kind, out.select("trajectory_id", "at.*", "steps")


def _named_by_place(loose: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Rows named by how many came before them: ranks within spans of lines, and counts of the spans before."""
    keys = ["source", "path", "span"]
    spans = loose.withColumn("span", F.expr(f"line div {span}"))
    counts = spans.groupBy(*keys).agg(F.count("*").alias("n"))
    before = counts.select(*keys, (F.sum("n").over(Window.orderBy(*keys)) - F.col("n")).alias("before"))  # a row for `span` lines
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("line")) - 1
    name = F.concat(F.lit(LOOSE), (F.col("before") + F.col("place")).cast("string"))
    return spans.withColumn("place", place).join(before, keys).select("source", "path", "line", name.alias("trajectory_id"), "step")


def prototype_rows(spark: SparkSession, paths: str | list[str], through: bool = False) -> DataFrame:
    """source, path, line, pos, text: the state texts that prototypes are made of, each row by its own kind.

    Steps give the triples of both observations (or the observation, if it holds none; nothing where it is null or empty), episodes the sentences of every step's, others every string in
    order of their keys' appearance. Files may mix the kinds."""
    row = F.col("row")
    none = F.array().cast("array<string>")
    of_step = F.concat(*[F.when(F.coalesce(text_of(row, k), F.lit("")) == "", none).otherwise(triple_texts(text_of(row, k))) for k in ("observation", "next_observation")])
    history = F.coalesce(F.try_variant_get(row, "$.history", "array<struct<observation:string,next_observation:string>>"), F.array())
    of_episode = F.flatten(F.transform(history, lambda h: F.concat(sentences(h["observation"]), sentences(h["next_observation"]))))
    strings = F.filter(F.map_values(F.from_json("text", "map<string,variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    of_other = F.transform(strings, lambda v: F.variant_get(v, "$", "string"))
    kind = kind_of_row(row)
    texts = F.when(kind == "steps", of_step).when(kind == "episodes", of_episode).otherwise(of_other)
    return variants(spark, paths, through).select("source", "path", "line", F.posexplode(texts).alias("pos", "text"))
