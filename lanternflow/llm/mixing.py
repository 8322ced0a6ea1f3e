"""Mixing sources to target weights by entropy balancing.

Among all document rates in [0, MOST] whose words add up to each source's target, the one with the least relative entropy
to the documents as they are is rate = min(MOST, exp(dual * size / mean size of the source)). The duals solve a convex
problem, by Newton iterations on the logarithm of the words, guarded by a bracket that encloses the root whatever the sizes:
a source's words are at most its size times exp(dual * least size / mean), and all rates are at their most from dual =
log(MOST) * mean / least size on. Each iteration is a distributed aggregation over a histogram of (source, size), to which
the documents are reduced once. A source that does not converge is an error. Rates become whole copies: sizes are taken from large to small,
and each size's copies make up for what the larger ones have left, so that the words taken end next to the target.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_split, fits_broadcast, mapped, saved

MOST = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
ROUNDS = 200
#: Tasks that write the table of duals, which has a row for each source.
STATE_PARTS = 4
#: Rows of one source and size are ranked in parts of about this many rows, so that no task gets a large group.
PART_ROWS = 512
MOST_PARTS = 4_096


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null: 0)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(blank_split(t)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return mapped(docs, of, "doc_id bigint, source string, size bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with rank, from 0 by code point, null last: sorted in range partitions, each of which
    begins after all rows of those before it, so that no task gets all sources."""
    order = F.col("source").asc_nulls_last()
    parts = saved(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sums = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sums.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    joined = parts.withColumn("here", here).join(before, F.col("part") == F.col("__part"))
    return joined.select("source", "source_size", (F.col("here") + F.col("before")).alias("rank"))


def targets(histogram: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight in the order of the sources' code points, null last, none above most
    times its size. What is above is shared again until none is: target = min(most * size, level * weight), and each round
    sets the level from what the sources below their most have left and their weights, as one aggregation."""
    total = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")
    t = saved(ranked(total).select("source", "source_size", weight.alias("weight")), "weights")
    every = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.sum("weight").alias("weight")).first()
    level = share * every["size"] / max(1, every["weight"] or 1)
    while True:  # ends: each round but the last takes a source more to its most
        full = F.col("source_size") * most <= level * F.col("weight")
        r = t.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        new = (share * every["size"] - most * r["full"]) / r["weight"] if r["weight"] else math.inf
        if new <= level * (1 + 1e-15):
            break
        level = new
    return t.select("source", "source_size", F.least((F.col("source_size") * most).cast("double"), level * F.col("weight")).alias("target"))


def _rate(size: Column, mean: Column, dual: Column, most: int) -> Column:
    return F.exp(F.least(dual * size / mean, F.lit(math.log(most))))


def duals(histogram: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """goal with mean and dual for each source: Newton on the dual, all sources at once, each a row of a small table.

    Raises ArithmeticError if a source is not at its target after ROUNDS rounds."""
    h = histogram.where("size > 0")
    mean = h.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    g = goal.join(mean, goal["source"].eqNullSafe(mean["source"]), "left").select(goal["source"], "source_size", "target", "mean", "least")
    # a target at the cap needs every rate at its most
    capped = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    unit = F.col("mean") / F.col("least")
    low = (F.least(F.log(F.col("target") / F.col("source_size")), F.lit(0.0)) - 1e-6) * unit
    high = (math.log(most) + 1e-6) * unit
    state = g.withColumn("low", low).withColumn("high", high).withColumn("dual", F.when(capped, F.col("high")).otherwise(F.lit(0.0)))
    state = saved(state.withColumn("done", capped | F.col("mean").isNull()).drop("least").coalesce(STATE_PARTS), "duals")
    few = fits_broadcast(state, 100_000)
    for _ in range(ROUNDS):
        if not state.where("not done").limit(1).count():
            return state
        s = state.select(F.col("source").alias("__s"), "mean", "dual", "target", "done")
        e = h.join(F.broadcast(s) if few else s, h["source"].eqNullSafe(F.col("__s"))).where("not done")
        rate = _rate(F.col("size"), F.col("mean"), F.col("dual"), most)
        words = F.col("n") * F.col("size") * rate
        moved = e.select("source", "mean", words.alias("words"), F.when(rate < most, words * F.col("size") / F.col("mean")).otherwise(0.0).alias("slope"))
        sums = moved.groupBy("source").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope")).withColumnRenamed("source", "__s")
        j = state.join(sums, state["source"].eqNullSafe(F.col("__s")), "left").drop("__s")
        gap = F.col("words") - F.col("target")
        near = F.abs(gap) <= 1e-9 * F.greatest(F.col("target"), F.lit(1.0))
        j = j.withColumn("low", F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("dual")).otherwise(F.col("high")))
        step = F.col("dual") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("words") > 0) & (step > F.col("low")) & (step < F.col("high"))
        nxt = F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        j = j.withColumn("next", F.when(F.col("done") | near, F.col("dual")).otherwise(nxt))
        closed = F.col("high") - F.col("low") <= 1e-14 * (F.abs(F.col("low")) + F.abs(F.col("high")))
        j = j.withColumn("done", F.col("done") | F.coalesce(near | closed, F.lit(False)))
        state = saved(j.select("source", "source_size", "target", "mean", "low", "high", F.col("next").alias("dual"), "done").coalesce(STATE_PARTS), "duals")
    left = state.where("not done").count()
    if left:
        raise ArithmeticError(f"{left} sources are not at their targets after {ROUNDS} rounds")
    return state


def _whole(most: int):
    def of(p: pd.DataFrame) -> pd.DataFrame:
        """Copies of each size of a source, from large to small: next to what is due by then, between none and most each."""
        p = p.sort_values("size", ascending=False)
        n, size, due, taken, out = p["n"].to_numpy(), p["size"].to_numpy(), np.cumsum((p["n"] * p["size"] * p["rate"]).to_numpy()), 0, []
        for i in range(len(p)):
            c = int(min(max(math.floor((due[i] - taken) / size[i] + 0.5), 0), most * int(n[i])))
            taken += c * int(size[i])
            out.append(c)
        return pd.DataFrame({"source": p["source"], "size": p["size"], "copies": out})

    return of


def mixed(documents: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each row of documents: doc_id, source, size, source_size, target, rate, copies (0 to most) and taken.

    Null sources are one source, ordered last; documents without words have size 0 and are not taken; ties between rows
    of one source and size go by a hash of the doc_id, so reruns agree. Repeated rows count as documents each."""
    docs = saved(sizes(documents), "sizes")
    histogram = saved(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    state = duals(histogram, saved(targets(histogram, share, weights, most).coalesce(STATE_PARTS), "targets"), most)
    # rounded, as the order of a distributed sum may move the last digits from run to run
    s = state.select(F.col("source").alias("__s"), "source_size", "target", "mean", F.round("dual", 9).alias("dual"))
    rated = histogram.join(F.broadcast(s) if fits_broadcast(state, 100_000) else s, histogram["source"].eqNullSafe(F.col("__s"))).drop("__s")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("size"), F.col("mean"), F.col("dual"), most)).otherwise(0.0))
    # a group is a source's distinct sizes: as many rows as there are lengths of documents, however many documents
    copies = rated.where("size > 0").select("source", "size", "n", "rate").groupBy("source").applyInPandas(_whole(most), "source string, size bigint, copies bigint")
    plan = rated.join(copies.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "copies"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left").drop("__s", "__z")
    plan = saved(plan.withColumn("copies", F.coalesce("copies", F.lit(0))).withColumn("parts", F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(MOST_PARTS)).cast("int")), "plan")
    p = plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "n", "source_size", "target", "rate", F.col("copies").alias("in_all"), "parts")
    j = docs.join(p, docs["source"].eqNullSafe(F.col("__s")) & (docs["size"] == F.col("__z"))).drop("__s", "__z")
    j = saved(j.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("parts"))), "parted")
    counts = j.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("here"))
    before = counts.withColumn("before", F.sum("here").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("here")).select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("part").alias("__p"), "before")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    r = j.withColumn("rank", rank).join(before, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("part") == F.col("__p")))
    each = F.floor(F.col("in_all") / F.col("n"))
    more = F.col("rank") + F.col("before") <= F.col("in_all") - each * F.col("n")
    r = r.withColumn("copies", (each + more.cast("int")).cast("bigint"))
    return r.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mixed() of all documents: nulls, empty and long texts, ties, repeated rows and empty tables as there."""
    d = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
