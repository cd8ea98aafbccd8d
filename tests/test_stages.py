"""Builds that are stopped and go on."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stepforge.operators import stages
from stepforge.operators.stages import Stage


def plan(fails=False, version="1"):
    def last(spark, t):
        if fails:
            raise RuntimeError("stopped")
        return t["even"].join(t["all"].withColumnRenamed("x", "y"), F.col("x") == F.col("y")).agg(F.count("*").alias("n"))

    return [Stage("all", lambda spark, t: spark.range(10).select(F.col("id").alias("x"))), Stage("even", lambda spark, t: t["all"].filter("x % 2 = 0"), ("all",), version), Stage("count", last, ("even", "all"))]


def files(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def test_a_stopped_build_goes_on(spark, tmp_path):
    stopped, whole = tmp_path / "a", tmp_path / "b"
    with pytest.raises(RuntimeError, match="stopped"):
        stages.build(spark, f"file://{stopped}", plan(fails=True))
    assert not (stopped / stages.MANIFEST).exists()
    tables, made = stages.build(spark, f"file://{stopped}", plan())
    assert made == ["count"] and tables["count"].first().n == 5
    again, every = stages.build(spark, f"file://{whole}", plan())
    assert every == ["all", "even", "count"] and files(stopped) == files(whole)
    assert (stopped / stages.MANIFEST).read_text() == (whole / stages.MANIFEST).read_text()
    for name in tables:
        assert sorted(map(tuple, tables[name].collect())) == sorted(map(tuple, again[name].collect()))
    assert [(s["name"], s["rows"]) for s in json.loads((whole / stages.MANIFEST).read_text())["stages"]] == [("all", 10), ("even", 5), ("count", 1)]
    assert stages.build(spark, f"file://{whole}", plan())[1] == []


def test_a_change_makes_anew_what_follows(spark, tmp_path):
    stages.build(spark, f"file://{tmp_path}", plan())
    assert stages.build(spark, f"file://{tmp_path}", plan(version="2"))[1] == ["even", "count"]
    assert stages.build(spark, f"file://{tmp_path}", plan(), inputs="others")[1] == ["all", "even", "count"]


def test_order_of_stages():
    with pytest.raises(ValueError, match="follow those they need"):
        stages.keys(plan()[::-1])
