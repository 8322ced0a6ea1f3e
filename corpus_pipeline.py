"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, mixing.

Each stage reads what its predecessor kept; rejected documents and lines, near copies and benchmark passages are gone
from then on. The last stage returns how many words the mix takes of each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanternflow.llm import decontam, linededup, mixing, qrules, simhash
from lanternflow.llm.common import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rules and the fences of their language and source. Null and empty texts fail; null
    languages and sources are groups of their own; repeated rows are judged alike; columns stay as they are."""
    return qrules.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the text cut to its kept lines and n_chars after it. A text that loses all its lines becomes empty."""
    return linededup.deduplicated(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last, then of the smallest hash of its text. Empty texts
    are one component."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the words that stand in windows of one benchmark item; rows with windows of several items go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: how many of its words the mix takes, with what that follows from. Null sources are one source."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SimHash components are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each over a saved table of what its predecessor kept. An empty table
    gives an empty result; other columns of documents, whatever their names, go along up to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
