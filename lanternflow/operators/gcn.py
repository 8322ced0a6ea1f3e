"""A graph convolution network as a comparator of the rules. Node features come from distributed aggregates; the network
itself runs on the driver, for graphs of at most MAX_NODES nodes (a bound that is checked)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ownership import SECRECY

MAX_NODES = 5_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 8, 300, 0.05, 5e-3, 3


def node_features(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """entity_id and seven columns of local topology. nodes: entity_id, entity_type, jurisdiction, n_sources, weakest_link."""
    out = e.groupBy(F.col("parent").alias("entity_id")).agg(F.count(F.lit(1)).alias("out_degree"), (F.sum("share_percent") / 100).alias("held"))
    into = e.groupBy(F.col("child").alias("entity_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    j = nodes.join(out, "entity_id", "left").join(into, "entity_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return j.select("entity_id", zero("out_degree"), zero("in_degree"), zero("held"), F.col("jurisdiction").isin(SECRECY).cast("double").alias("secrecy"), (F.col("entity_type") == "person").cast("double").alias("person"), zero("n_sources"), F.coalesce("weakest_link", F.lit(1.0)).alias("weakest_link"))


@dataclass
class Graph:
    ids: list[str]
    spread: np.ndarray  # normalised adjacency with loops
    x: np.ndarray  # standardised features


def gathered(nodes: DataFrame, e: DataFrame) -> Graph:
    rows = node_features(nodes, e).orderBy("entity_id").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"the comparator takes at most {MAX_NODES} nodes")
    ids = [r[0] for r in rows]
    at = {n: i for i, n in enumerate(ids)}
    m = np.eye(len(ids))
    for r in e.groupBy("parent", "child").agg(F.sum("confidence").alias("w")).collect():  # at most MAX_NODES squared, and as sparse as the graph
        if r.parent in at and r.child in at:
            m[at[r.parent], at[r.child]] += r.w
            m[at[r.child], at[r.parent]] += r.w
    root = 1 / np.sqrt(m.sum(1))
    x = np.array([r[1:] for r in rows], float).reshape(len(ids), -1)
    spread = x.std(0)
    return Graph(ids, m * np.outer(root, root), (x - x.mean(0)) / np.where(spread == 0, 1, spread))


def _squash(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


def train(g: Graph, labels: dict[str, bool], hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> tuple[dict[str, float], list[float]]:
    """A score for each node and the loss of each epoch. Two convolutions and a read-out, by plain gradient descent."""
    known = np.array([i for i, n in enumerate(g.ids) if n in labels], int)
    if not len(known):
        return {}, []
    y = np.array([float(labels[g.ids[i]]) for i in known])
    rng = np.random.default_rng(seed)
    sizes = [g.x.shape[1], hidden, hidden, 1]
    w = [rng.normal(0, 0.4, size=pair) for pair in zip(sizes, sizes[1:], strict=False)]

    def forward() -> tuple[list[np.ndarray], np.ndarray]:
        inputs, h = [], g.x
        for layer in w[:-1]:
            inputs.append(g.spread @ h)
            h = np.maximum(inputs[-1] @ layer, 0)
        return [*inputs, h], (h @ w[-1]).ravel()

    losses = []
    for _ in range(epochs):
        inputs, logits = forward()
        p = _squash(logits[known])
        losses.append(float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))))
        back = np.zeros((len(g.ids), 1))
        back[known, 0] = (p - y) / len(known)
        steps = [inputs[-1].T @ back]
        back = back @ w[-1].T
        for k in range(len(w) - 2, -1, -1):
            back = back * (inputs[k] @ w[k] > 0)
            steps.insert(0, inputs[k].T @ back)
            back = g.spread.T @ (back @ w[k].T)
        w = [layer - rate * (step + decay * layer) for layer, step in zip(w, steps, strict=True)]
    return dict(zip(g.ids, _squash(forward()[1]).tolist(), strict=True)), losses


def leave_one_out(labels: dict[str, bool], score: Callable[[dict[str, bool]], dict[str, float]], cut: float = 0.5) -> dict[str, bool]:
    """For each labelled node the verdict of a scorer that has not seen its label."""
    return {n: score({k: v for k, v in labels.items() if k != n}).get(n, 0.0) >= cut for n in labels}
