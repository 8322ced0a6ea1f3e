"""Population stability between two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import names as N

# The bands of the stability index and of review volume.
STABLE, ALERT, VOLUME_STABLE, VOLUME_ALERT, EPSILON = 0.10, 0.25, 0.15, 0.25, 1e-6


def psi_parts(base: DataFrame, current: DataFrame, category: str) -> DataFrame:
    """category, base_share, current_share, contribution for each value of a column in either frame (null is a value)."""
    count = lambda df, side: df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias(side))
    b, c = count(base, "b"), count(current, "c").withColumnRenamed("category", "category_c")
    j = b.join(c, b["category"].eqNullSafe(c["category_c"]), "full").select(F.coalesce("category", "category_c").alias("category"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("c", F.lit(0)).alias("c"))
    total = j.agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    j = j.join(F.broadcast(total))  # one row
    share = lambda x, n: F.greatest(F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0), F.lit(EPSILON))
    j = j.select("category", share("b", "nb").alias("base_share"), share("c", "nc").alias("current_share"))
    return j.withColumn("contribution", (F.col("current_share") - F.col("base_share")) * F.log(F.col("current_share") / F.col("base_share")))


def status(value: Column, stable: float = STABLE, alert: float = ALERT) -> Column:
    return F.when(value < stable, "stable").when(value < alert, "investigate").otherwise("alert")


def psi(base: DataFrame, current: DataFrame, category: str, name: str) -> DataFrame:
    """One row: signal, statistic, value, threshold, status."""
    v = psi_parts(base, current, category).agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("value"))
    return v.select(F.lit(name).alias("signal"), F.lit("psi").alias("statistic"), "value", F.lit(ALERT).alias("threshold"), status(F.col("value")).alias("status"))


def jurisdiction_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    of = lambda d: d.select(N.normalize_jurisdiction(F.col("jurisdiction")).alias("x"))
    return psi(of(base), of(current), "x", "jurisdiction_mix")


def source_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    return psi(base, current, "source", "source_mix")


def name_shape_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    of = lambda d: d.select(F.least(F.size(N.significant_tokens(F.col("name"))), F.lit(6)).alias("x"))
    return psi(of(base), of(current), "x", "name_shape")


def score_drift(base: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    of = lambda d: d.select(score_bin(F.col("score"), bins).alias("x"))
    return psi(of(base), of(current), "x", "match_score")


def score_bin(score: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), (score * bins).cast("int")))


def review_volume_drift(base_reviewed: Column, base_pairs: Column, reviewed: Column, pairs: Column) -> Column:
    """A struct of the relative change of the share under review, and its status."""
    before = F.when(base_pairs > 0, base_reviewed / base_pairs).otherwise(0.0)
    now = F.when(pairs > 0, reviewed / pairs).otherwise(0.0)
    change = F.when(before > 0, F.abs(now - before) / before).otherwise(F.when(now > 0, 1.0).otherwise(0.0))
    return F.struct(change.alias("value"), status(change, VOLUME_STABLE, VOLUME_ALERT).alias("status"))


def run_monitors(base: DataFrame, current: DataFrame) -> DataFrame:
    """The signals, and in each row the worst status of all."""
    signals = reduce(DataFrame.unionByName, [f(base, current) for f in (jurisdiction_drift, source_drift, name_shape_drift)])
    rank = F.create_map(F.lit("stable"), F.lit(0), F.lit("investigate"), F.lit(1), F.lit("alert"), F.lit(2))
    worst = signals.agg(F.max_by("status", rank[F.col("status")]).alias("overall"))
    return signals.join(F.broadcast(worst))  # one row


def simulate_designation_round(records: DataFrame, jurisdiction: str, multiple: int = 4) -> DataFrame:
    """records with so many more copies of one jurisdiction's."""
    hit = records.where(N.normalize_jurisdiction(F.col("jurisdiction")) == jurisdiction)
    return records.unionByName(hit.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(multiple)))).drop("__n"))
