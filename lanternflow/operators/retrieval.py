"""Guidance retrieval: tokens, BM25, a dense projection, rank fusion, routing, reranking. Inverted-index joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolution import written

# Stop words, number phrases in their order, synonyms, routing cues.
STOP = """a an and are as at be by for from has have in is it its of on or that the to was were will with this
these those which what when where how why does do can could should would must may""".split()
NUMBER_PHRASES = [
    (r"\btwenty[-\s]?five\b", "twenty-five 25"), (r"\b25\b", "25 twenty-five"), (r"\bfifty\b", "fifty 50"), (r"\b50\b", "50 fifty"),
    (r"\bthirty\b", "thirty 30"), (r"\b30\b", "30 thirty"), (r"\bfive\s+years\b", "five 5 years"), (r"\b5\s+years\b", "5 five years"),
]
SYNONYMS = {
    "exit": ["terminate", "terminating"], "exiting": ["terminating", "restricting"], "derisk": ["terminating", "restricting", "classes"], "derisking": ["terminating", "restricting", "classes"],
    "offboard": ["terminating"], "category": ["class", "classes"], "categories": ["classes"], "whole": ["entire"], "all": ["entire"], "decline": ["refuse", "declined"], "ubo": ["beneficial", "owner"],
    "shell": ["nominee"], "layering": ["concealment", "obscure"], "opaque": ["concealment"], "sar": ["suspicious", "report"], "cdd": ["customer", "due", "diligence"], "edd": ["enhanced", "due", "diligence"], "pep": ["politically", "exposed"],
}
REGIME_OF_SOURCE = {"FATF": "FATF", "FATF-GUID": "FATF", "FinCEN": "FinCEN", "FinCEN-CTA": "FinCEN", "FFIEC": "FFIEC"}
CUES = {
    "FinCEN": [r"\b31 ?cfr\b", r"\bcdd rule\b", r"\bcorporate transparency\b", r"\bcta\b", r"\bfincen\b", r"\breporting company\b", r"\bbeneficial ownership rule\b", r"\blegal entity customer\b", r"\bus (?:bank|firm|institution)\b"],
    "FATF": [r"\bfatf\b", r"\brecommendation ?\d+\b", r"\binterpretive note\b", r"\binternational standard\b", r"\bmutual evaluation\b"],
    "FFIEC": [r"\bffiec\b", r"\bexamin", r"\bmanual\b", r"\bsupervisor", r"\btesting procedure\b"],
}
K1, B, RRF_K, RERANK_DEPTH, DIMENSIONS = 1.2, 0.75, 60, 15, 96


_NUMBERED = r"\b(?:twenty|25|fifty|50|thirty|30|five|5)\b"


def tokenize(text: Column) -> Column:
    """Lower-case words without stop words, number phrases spelled both ways, synonyms after their words. Texts without any
    such number, and without a word that has synonyms, skip those steps."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spelled = low
    for pattern, replacement in NUMBER_PHRASES:
        spelled = F.regexp_replace(spelled, pattern, replacement)
    words = F.regexp_extract_all(F.when(low.rlike(_NUMBERED), spelled).otherwise(low), F.lit(r"[A-Za-z][A-Za-z0-9]*|\d+"), F.lit(0))
    words = F.filter(words, lambda t: ~t.isin(STOP))
    more = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wider = F.flatten(F.transform(words, lambda t: F.when(t.isin(*SYNONYMS), F.concat(F.array(t), F.try_element_at(more, t))).otherwise(F.array(t))))
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, SYNONYMS))), wider).otherwise(words)


def infer_regime(query: Column) -> Column:
    low = F.lower(query)
    n = {k: sum((low.rlike(p).cast("int") for p in v), F.lit(0)) for k, v in CUES.items()}
    best = F.greatest(*n.values())
    out = F.lit(None).cast("string")
    for k in reversed(list(n)):
        out = F.when((best > 0) & (n[k] == best), k).otherwise(out)
    return out


def regime_of(source: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIME_OF_SOURCE.items() for x in kv]), source)


def postings(docs: DataFrame, doc: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """doc, term, tf, doc_len."""
    return docs.select(F.col(doc).alias("doc"), F.size(tokens).alias("doc_len"), F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


#: Distinct query terms up to which a document's tokens are cut to them before anything else.
LISTED_TERMS = 20_000


def _kept_tokens(distinct: DataFrame) -> tuple[Column, bool]:
    """Of tokens those among distinct (term), and True; all of them, and False, if there are too many to be listed."""
    listed = [r["term"] for r in distinct.limit(LISTED_TERMS + 1).collect()]
    few = len(listed) <= LISTED_TERMS
    return (F.filter("tokens", lambda t: t.isin(listed)) if few else F.col("tokens")), few


def bm25(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", k1: float = K1, b: float = B) -> DataFrame:
    """query, doc, score for documents that share a term with the query; every query term counts once.

    Documents are read and tokenised once: their length and those tokens that a query has, if the queries have few enough
    distinct terms to be listed, go to a small table; else their tokens meet the terms by a join. Counts are aggregated
    before the scores."""
    terms = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct("tokens")).alias("term"))
    distinct = terms.select("term").distinct()
    kept, few = _kept_tokens(distinct)
    cut = written(docs.select(doc, F.size("tokens").alias("doc_len"), kept.alias("tokens")))
    size = cut.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))
    p = cut.select(F.col(doc).alias("doc"), "doc_len", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
    p = p if few else p.join(distinct, "term", "left_semi")
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = p.join(df, "term").join(F.broadcast(size))  # size is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = part.select("term", "doc", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))).alias("s"))
    return terms.join(part, "term").groupBy("query", "doc").agg(F.sum("s").alias("score"))


def top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """query, doc, score, rank (from 1): the k best of each query; ties by doc. digits: scores that are equal when rounded to
    them are ties, as sums in another order differ in their last digits."""
    by = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("query").orderBy(F.desc(by), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query, doc, score: the sum of 1 / (k + rank) over ranked lists."""
    every = rankings[0].select("query", "doc", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query", "doc", "rank"))
    return every.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


#: Numbers in one block of queries that meets all documents: with 128 dimensions about 8,000 queries, 8 MB.
BLOCK_NUMBERS = 1 << 20


def dense_topk(docs: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query, doc, score, rank: the k best documents of each query by the dot product of normalised vectors (columns query,
    qv; doc, dv), rounded; ties by doc.

    The stated queries meet all documents in blocks of bounded size: a block is numbered, collected and held against each
    Arrow batch of documents as one matrix product, and a batch gives its k best of each query only."""
    width = queries.select(F.max(F.size("qv"))).first()[0]
    if width is None:
        return top_k(queries.join(docs).select("query", "doc", F.lit(0.0).alias("score")).limit(0), k)
    kind, qkind = dict(docs.dtypes)["doc"], dict(queries.dtypes)["query"]
    block = max(1, BLOCK_NUMBERS // max(1, width))
    n = queries.count()
    parts = -(-n // block)
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(max(1, 2 * parts if parts > 1 else 1))))
    dealt = written(dealt) if parts > 1 else dealt
    out = None
    for i in range(2 * parts if parts > 1 else 1):
        rows = dealt.where(F.col("part") == i).select("query", "qv").collect()  # about half a block
        if rows:
            found = docs.select("doc", "dv").mapInArrow(_best_of([r["query"] for r in rows], _units([r["qv"] for r in rows]), k, digits), f"query {qkind}, doc {kind}, score double")
            out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def _units(vectors: list) -> np.ndarray:
    v = np.array(vectors, float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _best_of(ids: list, q: np.ndarray, k: int, digits: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0)
            if not len(docs):
                continue
            order = np.argsort(docs.to_numpy(zero_copy_only=False), kind="stable")  # equal scores go to the least doc
            scores = np.round(q @ _units(batch.column(1).to_pylist())[order].T, digits)
            for at in range(len(ids)):
                best = np.argsort(-scores[at], kind="stable")[:k]
                yield pa.RecordBatch.from_arrays([pa.array([ids[at]] * len(best)), docs.take(pa.array(order[best])), pa.array(scores[at, best])], names=["query", "doc", "score"])

    return over


class DenseIndex:
    """TF-IDF and a truncated SVD of a corpus of guidance sections, whose number is bounded, on the driver."""

    def __init__(self, tokens: dict[str, list[str]], dim: int = DIMENSIONS):
        self.ids = sorted(tokens)
        terms = sorted({t for ts in tokens.values() for t in ts})
        self.column = {t: i for i, t in enumerate(terms)}
        counts = np.array([self._counts(tokens[i]) for i in self.ids]).reshape(len(self.ids), len(terms))
        self.idf = np.log((1 + len(self.ids)) / (1 + (counts > 0).sum(0))) + 1
        m = self._unit(self._weights(counts))
        rank = max(1, min(dim, min(m.shape) - 1)) if m.size else 1
        self.basis = np.linalg.svd(m, full_matrices=False)[2][:rank].T if m.size else np.zeros((len(terms), 1))
        self.vectors = self._unit(m @ self.basis)

    def _counts(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros(len(self.column))
        for t in tokens:
            if t in self.column:
                out[self.column[t]] += 1
        return out

    def _weights(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * self.idf

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=-1, keepdims=True)
        return v / np.where(n == 0, 1, n)

    def search(self, tokens: list[str], k: int) -> list[tuple[str, float]]:
        s = self.vectors @ self._unit(self._weights(self._counts(tokens)) @ self.basis)
        return sorted(((i, float(x)) for i, x in zip(self.ids, s, strict=True)), key=lambda p: (-p[1], p[0]))[:k]


#: Digits to which reranked scores are compared.
RERANK_DIGITS = 9


def rerank(fused: DataFrame, queries: DataFrame, docs: DataFrame, depth: int = RERANK_DEPTH) -> DataFrame:
    """query, doc, score, rank: the first depth of fused (query, doc, rank) by rank, idf coverage, title and regime; the
    rest keeps its order behind them. Scores equal to nine digits are ties, and go by doc. queries: query, tokens, regime;
    docs: doc, tokens, title_tokens, regime; n counts rows of docs, and a term's df the doc that have it, as in bm25().

    All documents are read once, for the df of the queries' terms; only those of the head give their tokens."""
    head = fused.where(F.col("rank") <= depth).select("query", "doc", "rank")
    q = queries.select("query", F.array_distinct("tokens").alias("qt"), F.col("regime").alias("q_regime"))
    distinct = q.select(F.explode("qt").alias("term")).distinct()
    kept, few = _kept_tokens(distinct)
    cut = written(docs.select("doc", F.array_distinct(kept).alias("tokens")))
    n = cut.agg(F.count(F.lit(1)).alias("n"))
    p = cut.select("doc", F.explode("tokens").alias("term"))
    p = p if few else p.join(distinct, "term", "left_semi")
    df = p.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(n)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    near = docs.join(head.select("doc").distinct(), "doc", "left_semi")
    d = near.select("doc", F.array_distinct("tokens").alias("dt"), F.array_distinct("title_tokens").alias("tt"), F.col("regime").alias("d_regime"))
    j = head.join(q, "query").join(d, "doc")
    cover = j.select("query", "doc", F.explode("qt").alias("term"), "dt").join(idf, "term").groupBy("query", "doc").agg(F.sum("idf").alias("all"), F.sum(F.when(F.array_contains("dt", F.col("term")), F.col("idf")).otherwise(0.0)).alias("got"))
    j = j.join(cover, ["query", "doc"], "left")
    covered = F.when(F.coalesce("all", F.lit(0.0)) > 0, F.col("got") / F.col("all")).otherwise(0.0)
    title = F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", "tt")) / F.size("qt")).otherwise(0.0)
    score = 3.0 / F.col("rank") + 1.4 * covered + 0.8 * title + F.when(F.col("q_regime") == F.col("d_regime"), 2.2).otherwise(0.0)
    tail = fused.where(F.col("rank") > depth).select("query", "doc", (-F.col("rank").cast("double")).alias("score"))
    return top_k(j.select("query", "doc", score.alias("score")).unionByName(tail), 2**31 - 1, RERANK_DIGITS)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """recall, precision and mrr at k over the queries of relevant (query, doc)."""
    hits = relevant.join(ranked.where(F.col("rank") <= k).select("query", "doc", "rank"), ["query", "doc"], "left")
    per = hits.groupBy("query").agg(F.count(F.lit(1)).alias("want"), F.count("rank").alias("got"), F.min("rank").alias("first"))
    return per.agg(F.avg(F.col("got") / F.col("want")).alias("recall"), F.avg(F.col("got") / k).alias("precision"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
