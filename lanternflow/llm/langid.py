"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed letter n-grams. Each language's training vectors are clustered into
several centroids; a text takes the language of the centroid with the largest cosine. A text farther from its centroid
than nearly all of that centroid's own training texts is marked as rejected (its nearest language is still named).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, remainder, saved, sized
from .labelled import one_text

DIMENSIONS = 4_096
CENTROIDS = 3
#: The centroids are fitted on about this many labelled texts in all, as many of each language, picked by a hash of the id.
TRAIN_ROWS = 4_000
#: But about this many of each language, or all that it has, however many languages there are.
LEAST_ROWS = 50
REJECT_QUANTILE = 0.005
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray:
    """How often each bucket's 1-, 2- and 3-grams (bytes of the lower-case words) stand in the text."""
    a = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    two = a[:-1] * 257 + a[1:]
    three = two[:-1] * 257 + a[2:]
    buckets = [((g + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52) for salt, g in ((1 << 40, a[1:-1]), (1 << 41, two), (1 << 42, three))]
    return np.bincount(np.concatenate(buckets).astype(np.int64), minlength=DIMENSIONS)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of normalised rows; starts from rows far from each other."""
    picked = [int(np.argmax(v @ v.mean(0)))]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin((v @ v[picked].T).max(1))))
    c = v[picked]
    for _ in range(rounds):
        nearest = (v @ c.T).argmax(1)
        c = np.array([v[nearest == i].sum(0) if (nearest == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """idf, centroids (normalised rows), their languages and least cosines; None if train has no text with a letter.

    train: doc_id, text, lang, no nulls. A language may have few rows; it then has as many centroids as rows. Of rows that
    repeat an id and language one text counts, so the sample is bounded by rows, or LEAST_ROWS for each language."""
    known = saved(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")  # a row for each language
    n_langs = known.count()
    if not n_langs:
        return None
    share = F.least(F.lit(1.0), F.greatest(F.lit(rows / n_langs), F.lit(float(LEAST_ROWS))) / F.col("n"))
    picked = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    some = train.join(sized(known).select(F.col("lang"), share.alias("share")), "lang").where(picked)
    some = saved(one_text(some, "lang", "doc_id"), "languages")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [(lang, counts(t)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.string()), pa.array([np.minimum(c, 65_535).astype("<u2").tobytes() for _, c in keep], pa.binary())], names=["lang", "c"])

    found = sorted(mapped(some.select("lang", "text"), of, "lang string, c binary").collect())  # bounded by rows
    if not found:
        return None
    c = np.array([np.frombuffer(r["c"], "<u2") for r in found]).astype(np.float32)
    names = np.array([r["lang"] for r in found])
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))).astype(np.float32) + 1
    v = np.log1p(c) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    centroids, langs, least = [], [], []
    for name in sorted(set(names)):
        own = v[names == name]
        part = clustered(own, CENTROIDS)
        near = own @ part.T
        for i in range(len(part)):
            mine = near[near.argmax(1) == i, i]
            centroids.append(part[i])
            langs.append(str(name))
            least.append(float(np.quantile(mine, REJECT_QUANTILE)) if len(mine) else 1.0)
    return {"idf": idf, "centroids": np.array(centroids, np.float32), "langs": langs, "least": np.array(least)}


def languages(documents: DataFrame, train: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    A null text or one without letters is "und" with score 0; so is every text if there is nothing to learn from.
    Ties between centroids go to the language that is first by name. Repeated rows each get their row."""
    model = fit(train)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        preds, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = [i for i, t in enumerate(texts) if model and has_letter(t)]
        for i in at:
            near = model["centroids"] @ weighted(counts(texts[i]), model["idf"]).astype(np.float32)
            best = int(near.argmax())
            preds[i], scores[i], rejected[i] = model["langs"][best], min(max(float(near[best]), 0.0), 1.0), bool(near[best] < model["least"][best])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, of, "doc_id bigint, lang_pred string, score double, rejected boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """languages() of all documents: nulls, empty and long texts, ties, repeated rows and empty tables as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return languages(docs, train).withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
