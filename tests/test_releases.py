"""Release building, the model store, archives and settings."""

from __future__ import annotations

import json
import random
import zipfile
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from stepforge.__main__ import main
from stepforge.config import load_curricula
from stepforge.functions import text as tx
from stepforge.operators import graph, releases, splits, store
from stepforge.plans.catalog import queries
from stepforge.sources import archives, jsonl, lines
from stepforge.streaming import incremental


def test_balanced_scenes_by_brute_force(spark):
    rng = random.Random(5)
    counts = [(room, scene, task, rng.randrange(1, 9)) for room in "ab" for scene in range(9) for task in "xyz" if rng.random() < 0.6]
    got = {r.room: r.scenes for r in releases.balanced_scenes(spark.createDataFrame(counts, "room string, scene int, task string, n long"), 0.34).collect()}
    for room in "ab":
        table = {(s, t): n for r, s, t, n in counts if r == room}
        scenes, tasks = sorted({s for s, _ in table}), sorted({t for _, t in table})
        k = max(1, round(len(scenes) * 0.34))
        target = {t: max(1.0, sum(table.get((s, t), 0) for s in scenes) * k / len(scenes)) for t in tasks}

        def score(combo):
            sums = [sum(table.get((s, t), 0) for s in combo) for t in tasks]
            return sum(n > 0 for n in sums), min(sums), -round(sum(abs(n - target[t]) / target[t] for n, t in zip(sums, tasks, strict=True)), 9), sum(sums), -sum(combo)

        assert got[room] == list(max(combinations(scenes, k), key=score))


def test_eval_spread_by_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT lang, source, doc_id FROM '{sf_dir}/documents.parquet'").fetchall()
    used, want = Counter(), set()
    for lang in sorted({r[0] for r in rows}):
        left = [r for r in rows if r[0] == lang]
        for _ in range(min(25, len(left))):
            left.sort(key=lambda r: (used[r[1]], r[1], r[2]))
            row = left.pop(0)
            used[row[1]] += 1
            want.add(row)
    assert {tuple(r) for r in queries()["eval_holdout_spread"](spark, sf_dir).collect()} == want
    assert splits.eval_spread(spark.createDataFrame([], "t string, s int, k long"), "t", "s", "k", 3).collect() == []


def test_containment_levels(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "top"), ("x", "y"), ("y", "x"), ("both", "b"), ("both", "a"), ("top", "sky")]
    edges = spark.createDataFrame(chain, "child string, parent string")
    got = {r.node: (r.root, r.depth) for r in graph.containment_roots(edges, spark.createDataFrame([("top",), ("a",), ("b",)], "node string")).collect()}
    assert got == {f"n{i}": ("top", 13 - i) for i in range(13)} | {"both": ("a", 1), "top": ("top", 0)}


def test_clusters_without_rows(spark):
    placed = releases.clusters(spark.createDataFrame([], "scene int, room string, n long"), ["a", "b"])
    rows = spark.createDataFrame([(2, 1), (None, 2), (1, 3)], "scene int, key int")
    got = {r.key: (r.cluster, r.monitor_only) for r in releases.with_cluster(rows, placed, ["a", "b"], "scene", "key").collect()}
    assert got == {2: ("a", True), 3: ("b", True), 1: ("a", True)}  # a null scene comes first
    assert releases.with_cluster(rows.limit(0), placed, ["a", "b"], "scene", "key").count() == 0


def test_counts_are_checked(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "test")], "room string, file string")
    releases.check_counts(rows, ["room", "file"], {("a", "train"): 2})
    with pytest.raises(ValueError, match="b/test: 1 rows, expected 3; c/test: 0 rows, expected 1"):
        releases.check_counts(rows, ["room", "file"], {("b", "test"): 3, ("c", "test"): 1})


def test_store_follows_a_list(spark):
    names = list("abcde")
    frame = spark.createDataFrame(list(enumerate(names)), "pos int, model string")
    listed = lambda df: [r.model for r in df.orderBy("pos").collect()]
    for at in (-9, -2, 0, 3, 5, 8):
        want = list(names)
        want.insert(at, "new")
        assert listed(store.inserted(frame, at, spark.createDataFrame([("new",)], "model string"))) == want
    taken, rest = store.popped(frame, -2)
    assert (listed(taken), listed(rest)) == (["d"], list("abce"))
    assert [r.pos for r in store.removed(frame, "c").orderBy("pos").collect()] == [0, 1, 2, 3]
    for cut in ((1, 4, 2), (None, None, -1), (-2, None, 1), (9, None, 1)):
        assert listed(store.sliced(frame, *cut)) == names[slice(*cut)]
    assert listed(store.extended(frame, frame)) == names * 2
    with pytest.raises(IndexError):
        store.popped(frame, 5)


def test_zip_payloads_stop_early(spark, tmp_path):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for i in range(4):
                z.writestr(f"base{i % 2}/{name}{i}.json", json.dumps({"good": i != 1}) if i < 3 else "{")
    base, order = F.split("member", "/")[0], [F.col("member")]
    # the last members of base1 do not parse; nothing reads them where the first ones are enough
    got = archives.picked(spark, f"file://{tmp_path}/*.zip", r"\.json$", base, order, 1, lambda x: True)
    assert [(r.base, r.member) for r in got.orderBy("base").collect()] == [("base0", "base0/one0.json"), ("base1", "base1/one1.json")]
    with pytest.raises(ValueError, match="base0: 2 of 3 members after all 2"):
        archives.picked(spark, f"file://{tmp_path}/one.zip", r"base0/", base, order, 3, lambda x: x["good"])
    one = archives.picked(spark, f"file://{tmp_path}/*.zip", r"base0/", base, order, 3, lambda x: x["good"])
    assert [r.member for r in one.orderBy("pos").collect()] == ["base0/one0.json", "base0/one2.json", "base0/two0.json"]


def test_nested_keys_and_count(spark, tmp_path):
    rows = spark.range(3).select(F.struct(F.col("id").alias("z"), F.struct(F.lit(1).alias("b"), F.lit(2).alias("a")).alias("m")).alias("s"), F.array(F.struct(F.lit(1).alias("y"), F.lit(2).alias("x"))).alias("a"))
    assert jsonl.write_jsonl(rows, str(tmp_path / "out")) == 3
    written = sorted(line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines())
    assert written[0] == '{"a":[{"x":2,"y":1}],"s":{"m":{"a":2,"b":1},"z":0}}'


def test_unknown_rows_are_an_error(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"other": 1}\n')
    with pytest.raises(ValueError, match="known kind"):
        lines.evaluation_rows(spark, str(tmp_path / "rows.jsonl"))
    (tmp_path / "rows.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no rows"):
        jsonl.read_like_first(spark, str(tmp_path / "rows.jsonl"))


def test_strict_answers(spark):
    rows = spark.createDataFrame([("assistant \n",)], "x string")
    assert rows.select(tx.decoded_action(F.col("x"))).first()[0] == ""
    with pytest.raises(Exception, match="without an action"):
        rows.select(tx.decoded_action(F.col("x"), strict=True)).collect()


def test_passes_and_progress():
    class Done:
        def awaitTermination(self):  # noqa: N802
            left.pop()

    left = [1, 2, 3]
    assert incremental.until_covered(Done, lambda: len(left), 3) == 3
    left = list(range(99))
    with pytest.raises(ValueError, match="83 of 3 keys"):
        incremental.until_covered(Done, lambda: len(left), 3)
    told = []
    progress = incremental.Progress(100, every=2, tell=told.append)
    for _ in range(4):
        progress.add(10, 5.0)
    assert told == ["20 of 100 rows, 5.0 a second, 16 s left", "40 of 100 rows, 5.0 a second, 12 s left"]


def test_settings(tmp_path):
    path = tmp_path / "run" / "settings.json"
    path.parent.mkdir()
    stage = {"dataset": "d", "base_model": "m", "models": [0]}
    path.write_text(json.dumps({"train": [stage], "datasets": ["x"], "name": "2025-01-01_00-00-00"}))
    found = load_curricula(path)
    assert (found.name, found.output_dir, found.train[0].tokenizer_name) == ("run", str(tmp_path), "m")
    for bad, told in (({"train": [{"dataset": "d"}]}, "missing"), ({"train": [], "what": 1}, "unknown"), ({"train": [stage]}, "without a dataset"), ({"train": [], "retrieval_k": "3"}, "int is needed"), ([], "object")):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=told):
            load_curricula(path)


def test_commands(spark, sf_dir, tmp_path, capsys):
    assert main(["list"]) == 0 and "method_views" in capsys.readouterr().out
    assert main(["query", "sql", "checked_take"]) == 0 and "LIMIT 7" in capsys.readouterr().out
    assert main(["query", "write", "checked_take", sf_dir, str(tmp_path / "out")]) == 0 and "7 rows" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["query", "show", "no_such_query", sf_dir])
