"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

from __future__ import annotations

import duckdb
import pytest

from stepforge.plans.catalog import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, duck, name):
    got = queries()[name](spark, sf_dir).toPandas()
    if name in oracle_sql():
        assert rows_of(got) == rows_of(duck.sql(oracle_sql()[name]).df())
    else:
        assert len(got)


def test_fuzzy_matches_by_brute_force(spark, sf_dir, duck):
    from difflib import SequenceMatcher

    names = [n for (n,) in duck.sql("SELECT DISTINCT p_name FROM part").fetchall()]
    for r in queries()["fuzzy_class_match"](spark, sf_dir).collect():
        if r.tier == 4 or r["class"] is None:
            ratio = {n: SequenceMatcher(None, r.phrase.replace("_", " "), n).ratio() for n in names}
            best = max(ratio.values())
            assert (r["class"] is None) == (best < 0.88)
            assert r["class"] is None or ratio[r["class"]] == best


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["located_overlaps", "located_row_errors", "located_statistics", "located_trajectory_errors"])
def test_located_files_are_written_in_parts(spark, sf_dir, duck, monkeypatch, name):
    """No task writes a whole train or test file, however many rows it has, and lines are numbered through the parts."""
    from stepforge.plans import located_queries
    from stepforge.sources import lines

    paths, write = [], lines.write_parts
    monkeypatch.setattr(lines, "PART", 100)
    monkeypatch.setattr(lines, "write_parts", lambda rows, path, *rest: paths.append(path) or write(rows, path, *rest))
    got = located_queries.__dict__[name](spark, sf_dir).toPandas()
    assert rows_of(got) == rows_of(duck.sql(oracle_sql()[name]).df())
    sizes = [r["count"] for path in paths for r in lines.lines(spark, [f"{path}/role=train", f"{path}/role=test"]).groupBy("path").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 250 and len(sizes) >= 8


def test_located_rows_do_not_meet_by_scene(spark, sf_dir):
    """The few scenes come to the rows: no plan deals the rows out by scene, with which task sizes would follow a scene's rows."""
    from stepforge.plans import located_queries

    plan = located_queries._checked(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [scene#" in plan and "hashpartitioning(scene#" not in plan
