"""Labelled texts to learn from: a sample of bounded size, picked by a hash of the id, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, saved


def training_rows(documents: DataFrame, labels: DataFrame, label: str, rows: int, by: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, text, y (0 or 1): about rows labelled documents whose crc32(doc_id) mod by is not held_out, as a saved table.

    Null ids and labels teach nothing; an id with several labels counts once, with the largest; of rows that repeat an id
    the text with the smallest hash counts, so the sample is bounded by rows however often an id is repeated. Only the ids
    of the sample are broadcast."""
    found = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", by) != held_out))
    found = found.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    share = min(1.0, rows / max(1, found.count()))
    some = found.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return saved(one_text(texts.join(F.broadcast(some), "doc_id"), "doc_id", "y"), "sample")


def one_text(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows of each key the text with the smallest hash."""
    return rows.groupBy(*key).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
