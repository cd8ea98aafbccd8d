"""Incremental episodes: append files, skip what was written, keep running metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from stepforge.sources.jsonl import swap_in


def source(spark: SparkSession, folder: str, schema: StructType, form: str = "json", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def once(stream: DataFrame, key: str, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once, over restarts as well; with an event time, keys are forgotten when they can no longer come late."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def append(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Writes all that is there and stops; a later run goes on from the checkpoint."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running(stream: DataFrame, by: list[str], value: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the whole result of a complete-mode aggregate at path; a batch is written beside it and then takes its place."""

    def write(batch: DataFrame, _: int) -> None:
        swap_in(batch, path, lambda written: True)

    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def gated(stream: DataFrame, checkpoint: str, passes: Callable[[DataFrame], bool], then: Callable[[DataFrame], None]) -> StreamingQuery:
    """Hands a batch on only if it passes."""

    def act(batch: DataFrame, _: int) -> None:
        if passes(batch):
            then(batch)

    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates of the batches so far."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]


def until_covered(run: Callable[[], StreamingQuery], missing: Callable[[], int], n: int) -> int:
    """Runs passes until nothing is missing, at most 2 n + 10 of them for n expected keys; the number of passes. What is missing then is an error."""
    for done in range(2 * n + 10):
        if not missing():
            return done
        run().awaitTermination()
    if left := missing():
        raise ValueError(f"{left} of {n} keys missing after {2 * n + 10} passes")
    return 2 * n + 10


class Progress(StreamingQueryListener):
    """Tells rows so far, rows a second and the seconds left of an expected total, once in `every` batches."""

    def __init__(self, total: int, every: int = 50, tell: Callable[[str], None] = print):
        self.total, self.every, self.tell, self.rows, self.batches = total, every, tell, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows = self.batches = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.add(event.progress.numInputRows, event.progress.processedRowsPerSecond)

    def add(self, rows: int, rate: float | None) -> None:
        self.rows += rows
        self.batches += 1
        if self.batches % self.every == 0:
            left = f"{max(0, self.total - self.rows) / rate:.0f} s left" if rate else "rate unknown"
            self.tell(f"{self.rows} of {self.total} rows, {rate or 0:.1f} a second, {left}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
