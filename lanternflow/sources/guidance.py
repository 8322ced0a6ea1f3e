"""Guidance sections and golden questions from JSON, and the whole retrieval over them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.operators import retrieval


def sections(spark: SparkSession, path: str) -> DataFrame:
    """id, source, title, text."""
    return spark.read.option("multiLine", True).schema("sections array<struct<id:string,source:string,title:string,text:string>>").json(path).select(F.explode("sections").alias("s")).select("s.*")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, primary, secondary."""
    return spark.read.option("multiLine", True).schema("questions array<struct<qid:string,question:string,primary:array<string>,secondary:array<string>>>").json(path).select(F.explode("questions").alias("q")).select("q.*")


#: Sections up to which the projection is fitted on the driver.
MOST_SECTIONS = 20_000


def search(found: DataFrame, questions: DataFrame, candidates: int = 25) -> DataFrame:
    """query, doc, score, rank by BM25 and the dense projection, fused, routed and reranked: the last of rankings()."""
    return rankings(found, questions, candidates)["reranked"]


def rankings(found: DataFrame, questions: DataFrame, candidates: int = 25) -> dict[str, DataFrame]:
    """query, doc, score, rank of each step: bm25, dense, fused, reranked. questions: query, question.

    Sections are few by nature (a corpus of guidance), so the projection is fitted on the driver, which refuses more than
    MOST_SECTIONS; questions are any number and are ranked on the executors."""
    d = found.select(F.col("id").alias("doc"), retrieval.tokenize(F.concat_ws(" ", "id", F.concat("title", F.lit(".")), "text")).alias("tokens"), retrieval.tokenize(F.col("title")).alias("title_tokens"), retrieval.regime_of(F.col("source")).alias("regime"))
    q = questions.select("query", retrieval.tokenize(F.col("question")).alias("tokens"), retrieval.infer_regime(F.col("question")).alias("regime"))
    sparse = retrieval.top_k(retrieval.bm25(d.withColumnRenamed("doc", "doc_id"), q, query="query"), candidates)
    sections = d.select("doc", "tokens").limit(MOST_SECTIONS + 1).collect()
    if len(sections) > MOST_SECTIONS:
        raise ValueError(f"the projection is fitted on {MOST_SECTIONS} sections at most")
    index = retrieval.DenseIndex({r.doc: r.tokens for r in sections})
    kind = dict(q.dtypes)["query"]

    def ranked(batches):
        for batch in batches:
            for query, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = index.search(tokens, candidates)
                columns = [[query] * len(near), [x for x, _ in near], [s for _, s in near], list(range(1, len(near) + 1))]
                made = [pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["query", "doc", "score", "rank"])

    dense = q.select("query", "tokens").mapInArrow(ranked, f"query {kind}, doc string, score double, rank int")
    fused = retrieval.top_k(retrieval.rrf([sparse, dense]), candidates)
    return {"bm25": sparse, "dense": dense, "fused": fused, "reranked": retrieval.rerank(fused, q, d)}
