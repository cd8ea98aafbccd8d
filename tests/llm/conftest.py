"""Hand-written documents with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, row string, spans string"


@pytest.fixture(scope="session")
def odd_rows():
    words = [f"w{i}" for i in range(60)]
    near = words[:58] + ["other", "end"]
    far = words[:30] + [f"x{i}" for i in range(30)]
    texts = {
        1: " ".join(words), 2: "\n".join(words).upper(), 3: " ".join(near), 4: " ".join(far), 5: "", 6: None, 7: "  \t", 8: "One two three", 9: "one  TWO three",
        10: "one two", 11: "ÄÖ ÄÖ ÄÖ ÄÖ ÄÖ ÄÖ", 12: "the cat sat " * 4000, 13: "x" * 30_000, 14: "<|endoftext|> a  b \n c", 15: "mail me at joe.b@site.example.com or +1 (017) 555-7713 now",
    }
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", None, "a", "b", "c", "d") for i, t in texts.items()]
    return [*rows, rows[0], rows[5], (None, "one two three", "en", None, None, "a", "b", "c", "d"), (None, None, None, None, None, "a", "b", "c", "d")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
