"""Zip archives as a data source: `spark.read.format("episodes_zip").load(paths)` after `register(spark)`.

A partition is a range of an archive's members, and reads the range's entries of the directory alone. Directories stand at the end of
archives and are read by seeking; a filter on the member's name (equal, in, prefix, suffix, part) reaches the reader, so that members that fail it are not read, and payloads are
read only if they are asked for.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from stepforge.session import cut, ready

MEMBER_SCHEMA = "archive string, member string, place int, size long"
#: Members of a partition, bytes of payloads in a batch, members of a batch, and bytes of an archive that is read at once.
RANGE, BATCH_BYTES, BATCH_ROWS, SMALL = 1000, 8 << 20, 10_000, 4096
#: Partitions beyond which their ranges get longer, bytes of a directory, and of members, that are read at a time.
PARTITIONS, DIRECTORY_BYTES, BLOCK = 400, 8 << 20, 1 << 18
#: Records at the end of an archive: of its directory, where the long one is, the long one. Their fields are those of the format.
_END, _WHERE, _LONG = struct.Struct("<4s4H2LH"), struct.Struct("<4sLQL"), struct.Struct("<4sQ2H2L4Q")


def directory(file: pa.NativeFile) -> tuple[int, int, int, int]:
    """Where an archive's directory starts, its bytes and its entries, and the bytes that stand before the archive in its file."""
    size = file.size()
    file.seek(max(0, size - _END.size - _WHERE.size - _LONG.size - (1 << 16)))
    tail = file.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) - at < _END.size:
        raise zipfile.BadZipFile("no archive: it has no end record")
    _, _, _, _, n, length, offset, _ = _END.unpack_from(tail, at)
    end = size - len(tail) + at
    where = at - _WHERE.size
    if where >= 0 and tail[where : where + 4] == b"PK\6\7" and tail[where - _LONG.size : where - _LONG.size + 4] == b"PK\6\6":
        *_, n, length, offset = _LONG.unpack_from(tail, where - _LONG.size)
        end -= _WHERE.size + _LONG.size
    return end - length, length, n, end - length - offset


def ranges(file: pa.NativeFile, members: int) -> Iterator[tuple[int, int, int, int]]:
    """First place, end, offset and bytes of the directory's entries for each range of so many members; the directory is passed in pieces."""
    at, length, _, _ = directory(file)
    stop, first, place, held, base = at + length, at, 0, b"", at
    since = 0
    while at < stop:
        if at - base + 46 > len(held) and base + len(held) < stop:
            file.seek(at)
            base, held = at, file.read(min(DIRECTORY_BYTES, stop - at))
        if held[at - base : at - base + 4] != b"PK\1\2":
            raise zipfile.BadZipFile("no entry where the directory should have one")
        at += 46 + sum(struct.unpack_from("<3H", held, at - base + 28))
        place += 1
        if place - since == members:
            yield since, place, first, at - first
            since, first = place, at
    if place > since:
        yield since, place, first, at - first


class Excerpt:
    """An archive as a file whose directory holds a part of the entries alone; it is read in blocks."""

    def __init__(self, file: pa.NativeFile, n: int, offset: int, length: int) -> None:
        self.file, self.at, self.base, self.held = file, 0, 0, b""
        self.start, _, _, before = directory(file)
        file.seek(offset)
        entries = file.read(length)
        long_ = _LONG.pack(b"PK\6\6", _LONG.size - 12, 45, 45, 0, 0, n, n, length, self.start - before)
        where = _WHERE.pack(b"PK\6\7", 0, self.start - before + length, 1)
        self.tail = entries + long_ + where + _END.pack(b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        self.size = self.start + len(self.tail)

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        at = to + (0, self.at, self.size)[whence]
        if at < 0:
            raise OSError("a place before the file")
        self.at = at
        return at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.at + n, self.size)
        at, stop = self.at, min(end, self.start)
        got = b""
        if at < stop:
            if not self.base <= at <= stop <= self.base + len(self.held):
                self.file.seek(at)
                self.base, self.held = at, self.file.read(min(max(stop - at, BLOCK), self.start - at))
            got = self.held[at - self.base : stop - self.base]
        got += self.tail[max(at - self.start, 0) : max(end - self.start, 0)]
        self.at = max(at, end)
        return got


def _file(path: str) -> pa.NativeFile:
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)


def opened(path: str) -> zipfile.ZipFile:
    """An archive in any file system that workers reach."""
    file = _file(path)
    return zipfile.ZipFile(file if file.size() > SMALL else io.BytesIO(file.read()))  # zipfile seeks to before the start of an archive without members


def listed(paths: str) -> list[str]:
    """The archives that a path or pattern (`folder/*.zip`) names, in order."""
    from fnmatch import fnmatchcase

    from pyarrow.fs import FileSelector, FileSystem, FileType

    system, inner = FileSystem.from_uri(paths if "://" in paths else f"file://{paths}")
    scheme = paths.partition("://")[0] if "://" in paths else "file"
    if system.get_file_info(inner).type == FileType.File:
        return [f"{scheme}://{inner}"]
    folder, _, pattern = (inner, "", "*.zip") if system.get_file_info(inner).type == FileType.Directory else inner.rpartition("/")
    found = [i.path for i in system.get_file_info(FileSelector(folder, allow_not_found=True)) if i.type == FileType.File and fnmatchcase(i.base_name, pattern)]
    return [f"{scheme}://{p}" for p in sorted(found)]


class Members(InputPartition):
    """Members of an archive from a place on, and where their entries stand in its directory."""

    def __init__(self, archive: str, start: int, stop: int, offset: int = 0, length: int = 0) -> None:
        self.archive, self.start, self.stop, self.offset, self.length = archive, start, stop, offset, length


class Reader(DataSourceReader):
    def __init__(self, paths: str, range_: int, payload: bool) -> None:
        self.paths, self.range, self.payload, self.wanted = paths, range_, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("member",):
                self.wanted.append(f)
            else:
                yield f  # left to Spark

    def _fits(self, member: str) -> bool:
        tests = {EqualTo: lambda v: member == v, In: lambda v: member in v, StringStartsWith: member.startswith, StringEndsWith: member.endswith, StringContains: lambda v: v in member}
        return all(tests[type(f)](f.value) for f in self.wanted)

    def partitions(self) -> list[Members]:
        out, paths, total = [], listed(self.paths), 0
        for path in paths:
            with _file(path) as file:
                total += directory(file)[2]
        members = max(self.range, -(-total // PARTITIONS))
        for path in paths:
            with _file(path) as file:
                out += [Members(path, *of) for of in ranges(file, members)]
        return out or [Members("", 0, 0)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        names = ["archive", "member", "place", "size", *(["payload"] if self.payload else [])]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

        with _file(partition.archive) as file, zipfile.ZipFile(Excerpt(file, partition.stop - partition.start, partition.offset, partition.length)) as z:
            rows, size = [], 0
            for place, info in enumerate(z.infolist(), partition.start):
                if info.is_dir() or not self._fits(info.filename):
                    continue
                rows.append((partition.archive, info.filename, place, info.file_size, *([z.read(info)] if self.payload else [])))
                size += info.file_size if self.payload else 0
                if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()


class EpisodesZip(DataSource):
    """Options: path (an archive, a folder or a pattern), members (of a partition; more where there would be over PARTITIONS of them), payload (true: a binary column of contents)."""

    @classmethod
    def name(cls) -> str:
        return "episodes_zip"

    def _payload(self) -> bool:
        return str(self.options.get("payload", "false")).lower() == "true"

    def schema(self) -> str:
        return MEMBER_SCHEMA + (", payload binary" if self._payload() else "")

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"], int(self.options.get("members", RANGE)), self._payload())


def register(spark: SparkSession) -> SparkSession:
    """Makes episodes_zip known to the session, and lets filters reach its reader."""
    ready(spark).dataSource.register(EpisodesZip)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def members(spark: SparkSession, paths: str, payload: bool = False, range_: int = RANGE) -> DataFrame:
    """archive, member, place, size and, with payload, the content of every member."""
    return register(spark).read.format("episodes_zip").option("payload", str(payload).lower()).option("members", range_).load(paths)


def picked(spark: SparkSession, paths: str, pattern: str, base: Column, order: list[Column], quota: int, accept: Callable[[dict], bool], strict: bool = True) -> DataFrame:
    """base, pos, archive, member, payload: of each base the first `quota` JSON members, in order, that accept takes.

    Members are ranked within their base by names alone. A round reads the next members of the bases that still lack some, twice as many
    in every round; so no base is one task, and what is read beyond the quota is bounded by what was read before it. With strict, too few are an error; so is a member that does not parse, unless those before it are enough."""
    named = members(spark, paths).filter(F.col("member").rlike(pattern)).withColumn("base", base)
    place = F.row_number().over(Window.partitionBy("base").orderBy(*order, "archive", "member"))
    ranked = cut(named.select("base", "archive", "member", place.alias("nth")))
    sizes = ranked.groupBy("base").agg(F.count("*").alias("n"))
    state = cut(sizes.select("base", "n", F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("have")))
    found, ahead = [], quota

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, own in pdf.groupby("archive"):
                with opened(path) as z:
                    for row in own.itertuples():
                        text = z.read(row.member).decode()
                        try:
                            fault, fits = None, accept(json.loads(text))
                        except ValueError as e:  # it is an error only if the rows before it are not enough
                            fault, fits = f"{row.member}: {e}", True
                        if fits:
                            out.append((row.base, row.nth, path, row.member, text, fault))
            yield pd.DataFrame(out, columns=["base", "nth", "archive", "member", "payload", "fault"])

    while True:
        open_ = state.filter(F.col("have") < quota).filter("done < n")
        if open_.isEmpty():
            break
        todo = ranked.join(open_.select("base", "done", "have"), "base").filter(F.col("nth").between(F.col("done") + 1, F.col("done") + ahead))
        todo = todo.select("base", "nth", "archive", "member").repartition("archive", F.pmod("nth", F.lit(64)))
        taken = cut(todo.mapInPandas(test, "base string, nth int, archive string, member string, payload string, fault string"))
        found.append(taken)
        got = taken.groupBy("base").agg(F.count("*").alias("got"))
        state = state.join(got, "base", "left")
        more = (F.col("have") < quota) & (F.col("done") < F.col("n"))
        state = cut(state.select("base", "n", F.when(more, F.col("done") + ahead).otherwise(F.col("done")).alias("done"), (F.col("have") + F.coalesce("got", F.lit(0))).alias("have")))
        ahead *= 2
    if strict and (short := state.filter(F.col("have") < quota).orderBy("base").first()):
        raise ValueError(f"{short.base}: {short.have} of {quota} members after all {short.n}")
    if not found:
        return spark.createDataFrame([], "base string, pos int, archive string, member string, payload string")
    every = found[0]
    for more_ in found[1:]:
        every = every.unionByName(more_)
    pos = F.row_number().over(Window.partitionBy("base").orderBy("nth")) - 1
    payload = F.when(F.col("fault").isNotNull(), F.raise_error("fault")).otherwise(F.col("payload"))
    return every.withColumn("pos", pos).filter(F.col("pos") < quota).select("base", "pos", "archive", "member", payload.alias("payload"))


def write(rows: DataFrame, folder: str) -> None:
    """An archive `<archive>.zip` below folder for each archive of rows (archive, member, payload); a task writes each, a member at a time, beside its place and then renamed."""
    spark = ready(rows.sparkSession)
    target = folder if "://" in folder else f"file://{folder}"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        system, inner = FileSystem.from_uri(target)
        system.create_dir(inner, recursive=True)
        archive, out, z = None, None, None

        def close() -> None:
            if z is not None:
                z.close()
                out.close()
                system.move(f"{inner}/.{archive}.part", f"{inner}/{archive}.zip")

        for pdf in batches:
            for name, member, payload in zip(pdf["archive"], pdf["member"], pdf["payload"], strict=True):
                if name != archive:
                    close()
                    archive, out = name, system.open_output_stream(f"{inner}/.{name}.part", buffer_size=1 << 20)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(member, payload)
        close()
        yield pd.DataFrame({"n": []}, dtype="int64")

    named = rows.select(F.col("archive").cast("string"), "member", "payload")
    parts = spark.sparkContext.defaultParallelism
    named.repartition(parts, "archive").sortWithinPartitions("archive", "member").mapInPandas(pack, "n long").write.format("noop").mode("append").save()
