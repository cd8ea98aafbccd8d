"""The repository without its optional parts, in a process of its own."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert set(e.oracle_sql()) <= names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(e.entry(spark).count() > 0)
"""


@pytest.mark.parametrize("gone", [["stepforge/llm"], ["stepforge/llm", "corpus_pipeline.py"], ["stepforge/llm/words.py"]])
def test_without_llm(tmp_path, gone):
    own = tmp_path / "repo"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(own / name) if (own / name).is_dir() else (own / name).unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", PROGRAM], cwd=own, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.split()[-1] == "True"
