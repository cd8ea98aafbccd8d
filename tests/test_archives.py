"""Archives as a data source."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from stepforge.sources import archives


def packed(folder, name, members):
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        for member, content in members:
            z.writestr(member, content)


def test_ranges_and_filters(spark, tmp_path):
    packed(tmp_path, "a", [(f"x/{i}.json", f"{i}") for i in range(25)] + [("dir/", "")])
    packed(tmp_path, "b", [("readme.txt", "no")])
    packed(tmp_path, "c", [])
    (tmp_path / "other.dat").write_text("no archive")
    rows = archives.members(spark, str(tmp_path), payload=True, range_=10)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted((r.archive[-5:], r.member, r.place, r.size, bytes(r.payload).decode()) for r in rows.collect()) == sorted([("a.zip", f"x/{i}.json", i, len(str(i)), str(i)) for i in range(25)] + [("b.zip", "readme.txt", 0, 2, "no")])
    some = rows.filter(F.col("member").startswith("x/1") & (F.col("size") > 1))
    assert sorted(r.member for r in some.collect()) == [f"x/{i}.json" for i in range(10, 20)]
    assert archives.members(spark, f"{tmp_path}/b*.zip").columns == ["archive", "member", "place", "size"]
    assert archives.members(spark, f"{tmp_path}/none*.zip").count() == 0


def test_reader_takes_filters_on_names(tmp_path):
    packed(tmp_path, "a", [("x/1", "1"), ("x/2", "2"), ("y/1", "3")])
    reader = archives.Reader(str(tmp_path), 2, True)
    size = GreaterThan(("size",), 3)
    assert list(reader.pushFilters([StringStartsWith(("member",), "x"), size, In(("member",), ("x/2", "y/1"))])) == [size]
    read = [m for p in reader.partitions() for b in reader.read(p) for m in b.column("member").to_pylist()]
    assert read == ["x/2"]
    reader.wanted = [EqualTo(("member",), "y/1")]
    assert [b.column("payload").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[b"3"]]


def test_filters_reach_the_reader(spark, tmp_path):
    """A member that the filter drops is not even decompressed."""
    packed(tmp_path, "a", [("good.json", "{}"), ("broken.json", "x" * 50)])
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"x" * 50)] = ord("y")  # its checksum is wrong now
    (tmp_path / "a.zip").write_bytes(raw)
    rows = archives.members(spark, str(tmp_path), payload=True)
    assert [bytes(r.payload) for r in rows.filter("member = 'good.json'").collect()] == [b"{}"]


def test_rounds(spark, tmp_path):
    """Quotas that take several rounds of reading, bases that run out, members in a given order."""
    packed(tmp_path, "a", [(f"b{b}/{i:03d}.json", json.dumps({"ok": i % 20 == 19 or b == 2})) for b in range(3) for i in range(100 if b < 2 else 2)])
    base, number = F.split("member", "/")[0], F.regexp_extract("member", r"(\d+)\.json", 1).cast("int")
    got = archives.picked(spark, str(tmp_path), r"\.json$", base, [-number], 3, lambda x: x["ok"], strict=False)
    assert sorted((r.base, r.pos, r.member) for r in got.collect()) == sorted([(f"b{b}", k, f"b{b}/{n:03d}.json") for b in range(2) for k, n in enumerate((99, 79, 59))] + [("b2", 0, "b2/001.json"), ("b2", 1, "b2/000.json")])
    assert archives.picked(spark, str(tmp_path), "none", base, [number], 3, lambda x: True).collect() == []


def test_written_archives(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 3).alias("archive"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("payload"))
    archives.write(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.zip", "1.zip", "2.zip"]
    back = archives.members(spark, str(tmp_path / "out"), payload=True).select("member", F.col("payload").cast("string").alias("payload"))
    assert sorted(map(tuple, back.collect())) == sorted((r.member, r.payload) for r in rows.collect())


def test_a_range_reads_its_own_entries(tmp_path, monkeypatch):
    """What is wrong with an entry of the directory is met by the task of its range alone, since no other reads it."""
    packed(tmp_path, "a", [(f"m{i}", str(i)) for i in range(40)])
    parts = archives.Reader(str(tmp_path), 10, True).partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 10), (10, 20), (20, 30), (30, 40)]
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.rindex(b"PK\x01\x02")] = 0
    (tmp_path / "a.zip").write_bytes(raw)
    reader = archives.Reader(str(tmp_path), 10, True)
    assert [x for p in parts[:3] for b in reader.read(p) for x in b.column("payload").to_pylist()] == [str(i).encode() for i in range(30)]
    with pytest.raises(zipfile.BadZipFile):
        list(reader.read(parts[3]))


@pytest.mark.parametrize("form", ["plain", "comment", "prefix", "long"])
def test_forms_of_directories(tmp_path, monkeypatch, form):
    """Comments at the end, bytes before the archive, long records, directories passed in small pieces, and more ranges than partitions."""
    for name, n in (("DIRECTORY_BYTES", 100), ("BLOCK", 7), ("PARTITIONS", 6)):
        monkeypatch.setattr(archives, name, n)
    if form == "long":
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 10)
    want = [(f"{'d' * (i % 60)}/é{i}", f"{i}é".encode() * (i % 9)) for i in range(50)]
    (tmp_path / "a.zip").write_bytes(b"before" * 9 if form == "prefix" else b"")
    with zipfile.ZipFile(tmp_path / "a.zip", "a", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"x" * 300 if form == "comment" else b""
        for member, content in want:
            z.writestr(member, content)
    reader = archives.Reader(str(tmp_path), 3, True)
    parts = reader.partitions()
    assert [p.start for p in parts] == list(range(0, 50, 9))
    batches = [b for p in parts for b in reader.read(p)]
    assert [r for b in batches for r in zip(b.column("member").to_pylist(), b.column("payload").to_pylist(), strict=True)] == want
    assert [i for b in batches for i in b.column("place").to_pylist()] == list(range(50))
