"""Line numbers over splits, and files of rows of several kinds."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from stepforge.sources import jsonl, lines


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_numbers_over_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(3)
    want = {}
    for name, n in (("a.txt", 400), ("b.txt", 1), ("c.txt", 0), ("d.txt", 150)):
        own = ["x" * rng.choice((0, 1, 5, 700 if n == 150 else 20)) + str(i) * (i % 3) for i in range(n)]
        (tmp_path / name).write_bytes((end.join(own) + (end if n > 1 else "")).encode())
        want |= {(name, i + 1): x for i, x in enumerate(own)}
    rows = lines.lines(spark, str(tmp_path))
    assert rows.select("path", "block").distinct().count() > 20
    name = F.element_at(F.split("path", "/"), -1)
    got = {(r[0], r.line): r.text for r in lines.numbered(rows).select(name, "line", "text").collect()}
    assert got == want
    some = {(r[0], r.line): r.text for r in lines.located(rows, F.length("text") == 1).select(name, "line", "text").collect()}
    assert some == {k: x for k, x in want.items() if len(x) == 1}


def test_malformed_lines_of_large_files(spark, tmp_path, small_splits):
    rows = [json.dumps({"a": i}) for i in range(300)]
    for i, bad in ((7, "{"), (100, ""), (250, '{"a": "x"}')):
        rows[i] = bad
    (tmp_path / "rows.jsonl").write_text("\n".join(rows) + "\n")
    got = jsonl.malformed(spark, str(tmp_path), "a int", blank_is_error=True).select("line").collect()
    assert sorted(r.line for r in got) == [8, 101, 251]
    with pytest.raises(ValueError, match=r"rows.jsonl:8: "):
        jsonl.read_strict(spark, str(tmp_path / "rows.jsonl"), "a int")


def written(folder, *files):
    for i, rows in enumerate(files):
        (folder / f"{i}.jsonl").write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return [str(folder / f"{i}.jsonl") for i in range(len(files))]


def step(action, **meta):
    return {"instruction": "i", "observation": "o", "action": action, "next_observation": "n", "_meta": meta} if meta else {"instruction": "i", "observation": "o", "action": action, "next_observation": "n"}


def test_steps_without_ids(spark, tmp_path, small_splits):
    first = [step("a", trajectory_id="t", step_index=2), step("b"), step("c", trajectory_id="t"), "", step("d", trajectory_id=None, step_index=5), step("e", trajectory_id=7, step_index="1")]
    second = [step("f", trajectory_id=7, step_index=0), step("g", trajectory_id="t", step_index=0), *[step(f"h{i}") for i in range(30)]]
    kind, rows = lines.evaluation_rows(spark, written(tmp_path, first, second))
    got = {r.trajectory_id: [s.action for s in r.steps] for r in rows.collect()}
    assert kind == "steps"
    assert got == {"t": ["c", "g", "a"], "7": ["f", "e"], "legacy-row-0": ["b"], "legacy-row-1": ["d"], **{f"legacy-row-{i + 2}": [f"h{i}"] for i in range(30)}}


def test_kind_of_the_first_row(spark, tmp_path):
    episode = {"task": "x", "trial_name": "y", "history": [{"observation": "o", "action": "a", "next_observation": "n", "dones": True}]}
    kind, rows = lines.evaluation_rows(spark, written(tmp_path, [episode, {**step("a"), "history": []}]))
    assert kind == "episodes" and sorted(len(r.history) for r in rows.collect()) == [0, 1]
    kind, rows = lines.evaluation_rows(spark, written(tmp_path, [step("a"), {**step("b"), "history": []}]))
    assert kind == "steps" and rows.count() == 2
    for bad in ([step("a"), episode], [episode, step("a")], [step("a"), "{"]):
        with pytest.raises(Exception, match=r"0.jsonl:2: no "):
            lines.evaluation_rows(spark, written(tmp_path, bad))[1].collect()
    with pytest.raises(ValueError, match="no known kind"):
        lines.evaluation_rows(spark, written(tmp_path, [{"a": 1}, episode]))
    with pytest.raises(ValueError, match="no rows"):
        lines.evaluation_rows(spark, written(tmp_path, [""]))


def test_prototype_rows(spark, tmp_path):
    rows = [
        {**step("a"), "observation": "( a, is, b ) and (c)", "next_observation": "plain"}, {**step("a"), "observation": None, "next_observation": ""}, {"history": [{"observation": "One. Two!\nThree", "next_observation": None}]},
        {"history": []}, {"z": "last", "a": 5, "m": None, "b": ["x"], "c": "first"}, {"a": 1},
    ]
    got = [(r.line, r.pos, r.text) for r in lines.prototype_rows(spark, written(tmp_path, rows)).collect()]
    assert sorted(got) == [(1, 0, "(a, is, b)"), (1, 1, "(c)"), (1, 2, "plain"), (3, 0, "One."), (3, 1, "Two!"), (3, 2, "Three"), (5, 0, "last"), (5, 1, "first")]


def test_parts_of_files(spark, tmp_path, small_splits, monkeypatch):
    """Files are written in parts, none of them by one task, and their lines are numbered through the parts."""
    monkeypatch.setattr(lines, "PART", 50)
    path, n = str(tmp_path / "out"), 600
    rows = spark.range(n).withColumn("file", (F.col("id") % 2).cast("int")).repartition(5, F.xxhash64("id"))
    lines.write_parts(rows, path, "file", ["id"], F.when(F.col("id") % 50 == 3, "").otherwise(F.concat(F.lit('{"id": '), "id", F.lit("}"))))
    assert all(len(list((tmp_path / "out" / f"file={i}").glob("*.txt"))) > 3 for i in range(2))
    assert max(len(p.read_text().split("\n")) for p in (tmp_path / "out").rglob("*.txt")) < n // 4
    folders = [f"{path}/file={i}" for i in range(2)]
    want = {(k % 2, k // 2 + 1): "" if k % 50 == 3 else f'{{"id": {k}}}' for k in range(n)}
    found = lines.numbered(lines.lines(spark, folders), through=True)
    assert {(r.source, r.line): r.text for r in found.collect()} == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    bad = jsonl.malformed(spark, folders, "id long", blank_is_error=True, through=True)
    assert sorted(r.line for r in bad.collect()) == sorted(k for (_, k), x in want.items() if not x)
