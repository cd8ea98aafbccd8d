"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm.common import SLICE_BYTES, kept, table
from stepforge.llm.language import identified
from stepforge.llm.near_dups import first_of_each
from stepforge.llm.packing import packed_documents
from stepforge.llm.personal_data import sanitised
from stepforge.llm.registry import tokenizer
from stepforge.llm.toxicity import scored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that are rejected go.

    Null, empty and letterless texts go too. Repeated rows are each decided alike, a null doc_id is no reason to go, all
    columns stay, an empty table gives an empty one; the same holds for the next stage."""
    return identified(docs).filter("not rejected").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; null and empty texts are scored as texts without words."""
    return scored(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows that repeat a kept doc_id stay once; rows without doc_id, and null or wordless texts, are no one's duplicates
    and stay. All columns stay, an empty table gives an empty one."""
    return first_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that give it away replaced; n_chars follows the new text.

    Null texts stay null, repeated rows are rewritten alike, all columns stay, an empty table gives an empty one."""
    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document: the sequence that holds it and its place there.

    A null or empty text is one piece, the end id; repeated rows are packed each; an empty table gives no rows."""
    # workers of the stages before hold memory of their own
    return packed_documents(docs, tokenizer("word_bpe_49k.json"), remembered=100_000, limit=SLICE_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Learned models and clustered links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
