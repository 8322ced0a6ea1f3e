"""A quality classifier by Bradley-Terry ranking.

A document's worth is linear in its features. Of a preferred and a less good document the first wins with the
probability sigmoid(difference of worths), so the weights come from logistic loss on differences of features. Worths are
then cut at a quantile: the share of less good documents among those that it learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, remainder
from .labelled import training_rows
from .qrules import statistics

#: At most about this many labelled documents and this many preference pairs are learned from.
TRAIN_ROWS = 12_000
PAIRS = 60_000
RIDGE = 1e-3
ROUNDS = 25
FEATURES = 17


def features(text: str | None) -> list[float]:
    n, chars, n_symbols, n_dup, n_repeat, _, _, top_word, change, *_ = statistics(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    symbols, repeat = n_symbols / max(1, chars), n_repeat / max(1, n)
    dup = n_dup / max(1, sum(1 for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")))
    top, runs = (top_word, 1 - change) if n >= 20 else (0.0, 0.0)
    size = max(1, len(raw))
    upper = sum(map(raw.count, (bytes([c]) for c in range(65, 91)))) / size
    stops, marks = sum(map(raw.count, (b".", b",", b";"))) / size, sum(map(raw.count, (b"!", b"?"))) / size
    digits = sum(map(raw.count, (bytes([c]) for c in range(48, 58)))) / size
    distinct = len(set(raw.split())) / max(1, n)
    dense = lambda x: float(np.log(x + 0.003))
    return [
        1.0 if n else 0.0, np.log1p(n), min(n, 20) / 20, chars / max(1, n) / 10, symbols, dense(symbols), repeat, dup, dense(upper), upper, dense(marks), stops * 10, digits * 10, distinct, top, dense(top), dense(runs),
    ]


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Weights, mean and scale of the features, the cut and the steepness over it. One class alone, or nothing, teaches
    no order: all weights are then 0 and the score is the share of label 1 (a half of nothing)."""
    share = float(y.mean()) if len(y) else 0.5
    empty = {"w": np.zeros(FEATURES), "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "cut": -float(np.log((share + 1e-6) / (1 - share + 1e-6))), "steep": 1.0}
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return empty
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]  # each row: a preferred document less a worse one
    w = np.zeros(FEATURES)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.minimum(d @ w, 50.0)))
        gradient = d.T @ p / pairs - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4.0 / max(1e-12, float(np.linalg.norm(step))))
        if np.abs(step).max() < 1e-6:
            break
    worth = np.sort(z @ w)
    k = len(bad)  # the quantile of the less good share, between the two worths beside it
    cut = float(worth[k - 1] + worth[k]) / 2
    return {"w": w, "mean": mean, "scale": scale, "cut": cut, "steep": 1.0}


def learned(train: DataFrame) -> dict:
    """fit() on the features of the training rows, in an order that does not depend on the run."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    found = sorted((r["y"], r["x"]) for r in mapped(train.select("y", "text"), of, "y int, x array<double>").collect())  # bounded by TRAIN_ROWS
    return fit(np.array([r[1] for r in found], float).reshape(-1, FEATURES), np.array([r[0] for r in found], int))


def scores(documents: DataFrame, train: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, score. Null and empty texts are scored like others, by their features."""
    model = learned(train)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, FEATURES)
        worth = (x - model["mean"]) / model["scale"] @ model["w"] - model["cut"]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(worth * model["steep"], -50, 50))))], names=["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, of, "doc_id bigint, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """scores() of all documents, learned from labels.quality: nulls, empty and long texts, repeated rows as there. Ties of
    scores stay ties; a score of just 0.5 is predicted 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = scores(docs, training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", TRAIN_ROWS))
    return d.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
