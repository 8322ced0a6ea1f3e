"""Measures, splits without leakage, weight fitting, a token memoriser, promotion gates."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import names

from .ownership import prf
from .resolution import WEIGHTS

MIN_TOKEN_PRECISION = 0.8
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85)
# Least values for promotion.
GATES = {"er_f1": 0.90, "candidate_recall": 0.97, "er_precision": 0.95, "layering_precision": 0.80, "recall_at_5": 0.85, "citation_resolution": 0.99, "language_gate": 1.0}


def pair_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of pairs (a, b)."""
    p, t = predicted.select("a", "b").distinct().withColumn("p", F.lit(True)), truth.select("a", "b").distinct().withColumn("t", F.lit(True))
    c = p.join(t, ["a", "b"], "full").agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & F.col("t").isNull()).alias("fp"), F.count_if(F.col("t") & F.col("p").isNull()).alias("fn"))
    return prf(c)


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """A struct of the ends of the interval; both 0 of nothing."""
    p, n = successes / total, total
    mid, half, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low = F.when(n > 0, F.greatest((mid - half) / below, F.lit(0.0))).otherwise(0.0)
    return F.struct(low.alias("low"), F.when(n > 0, F.least((mid + half) / below, F.lit(1.0))).otherwise(0.0).alias("high"))


def half_of(key: Column, share: float = 0.4, seed: int = 7) -> Column:
    """train or test by a hash of the key."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000), "test").otherwise("train")


def cluster_level_split(members: DataFrame, share: float = 0.4, seed: int = 7) -> DataFrame:
    """cluster_id, record_id, half: whole clusters go to one half, so no record is in both."""
    return members.withColumn("half", half_of(F.col("cluster_id"), share, seed))


def pair_level_split(pairs: DataFrame, share: float = 0.4, seed: int = 7) -> DataFrame:
    """a, b, half: pairs are dealt alone, so records leak between the halves."""
    return pairs.withColumn("half", half_of(F.concat_ws("|", "a", "b"), share, seed))


def shared_records(split: DataFrame) -> DataFrame:
    of = lambda h: split.where(F.col("half") == h).select(F.explode(F.array("a", "b")).alias("record_id"))
    return of("train").intersect(of("test"))


def negatives(candidates: DataFrame, positives: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs with both ends among members (record_id) that are no positive pair."""
    m = members.select("record_id").distinct()
    c = candidates.join(m.withColumnRenamed("record_id", "a"), "a", "left_semi").join(m.withColumnRenamed("record_id", "b"), "b", "left_semi")
    return c.select("a", "b").join(positives.select("a", "b"), ["a", "b"], "left_anti")


def rescore(weights: dict[str, float] = WEIGHTS) -> Column:
    """The score of a row of features under other weights; a birth-date conflict caps it at 0.2."""
    s = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    s = F.when(F.col("identifier_match") == 1.0, F.greatest(s, F.lit(0.95))).otherwise(s)
    s = F.when(F.col("birth_date_match") < 0, F.least(s, F.lit(0.2))).otherwise(s)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def trial_weights(trials: int, seed: int) -> list[tuple]:
    """trial and its weights in the order of WEIGHTS: the fixed ones first, then random ones that sum to 1."""
    rng = random.Random(seed)
    drawn: list[tuple] = [(0, *WEIGHTS.values())]
    for trial in range(1, trials):
        raw = [rng.random() for _ in WEIGHTS]
        drawn.append((trial, *[x / (sum(raw) or 1.0) for x in raw]))
    return drawn


def weights_of(best: DataFrame, trials: int = 400, seed: int = 11) -> dict:
    """weights and match_threshold of the best trial, as a configuration for scoring."""
    row = best.first()
    return {"weights": dict(zip(WEIGHTS, trial_weights(trials, seed)[row["trial"]][1:], strict=True)), "match_threshold": row["threshold"]}


def fit(table: DataFrame, trials: int = 400, seed: int = 11, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """trial, threshold, tp, fp, fn, precision, recall, f1 of the best of random weights, by f1 to four digits; the first trial,
    then the lowest threshold, of equals. table: features and label, and n if a row stands for several pairs.

    Rows of the same features and label are counted first, so that each of these meets the trials once, however many pairs
    have it. A score is reduced to the number of thresholds that it reaches; only counts by that number meet the thresholds."""
    drawn, steps = trial_weights(trials, seed), sorted(set(thresholds))
    frame = table.sparkSession.createDataFrame(drawn, "trial int, " + ", ".join(f"w_{k} double" for k in WEIGHTS))
    n = F.sum("n") if "n" in table.columns else F.count(F.lit(1))
    t = table.groupBy(*WEIGHTS, "label").agg(n.alias("n")).join(F.broadcast(frame))
    s = sum((F.col(k) * F.col(f"w_{k}") for k in WEIGHTS), F.lit(0.0))
    s = F.when(F.col("identifier_match") == 1.0, F.greatest(s, F.lit(0.95))).otherwise(s)
    s = F.when(F.col("birth_date_match") < 0, F.least(s, F.lit(0.2))).otherwise(s)
    t = t.select("trial", "label", "n", s.alias("s"))
    reached = sum(((F.col("s") >= v).cast("int") for v in steps), F.lit(0))
    counted = t.groupBy("trial", "label", reached.alias("reached")).agg(F.sum("n").alias("n"))
    x = counted.select("trial", "label", "n", "reached", F.posexplode(F.array(*map(F.lit, steps))).alias("at", "threshold"))
    hit = F.col("reached") > F.col("at")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")
    c = x.groupBy("trial", "threshold").agg(total(hit & F.col("label")).alias("tp"), total(hit & ~F.col("label")).alias("fp"), total(~hit & F.col("label")).alias("fn"))
    return prf(c).orderBy(F.desc(F.round("f1", 4)), "trial", "threshold").limit(1)


def significant(name: Column) -> Column:
    """The tokens that a memoriser reads of a name."""
    return F.array_distinct(names.significant_tokens(name))


def memorised_tokens(pairs: DataFrame, least: float = MIN_TOKEN_PRECISION) -> DataFrame:
    """token, pos, neg: tokens that two names share (a_tokens, b_tokens) and that are precise on labelled pairs."""
    each = pairs.select("label", F.explode(F.array_intersect("a_tokens", "b_tokens")).alias("token"))
    c = each.groupBy("token").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    return c.where((F.col("pos") > 0) & (F.col("pos") >= least * (F.col("pos") + F.col("neg"))))


def memoriser_predict(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    each = pairs.select("a", "b", F.explode(F.array_intersect("a_tokens", "b_tokens")).alias("token"))
    return each.join(tokens.select("token"), "token", "left_semi").select("a", "b").distinct()


def majority_seed(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_id, seed, votes, seeds, purity: the truth seed of most of an entity's records; ties by seed. truth: record_id,
    seed. An entity of several seeds is a false merge; purity is the share of the winner."""
    j = entities.select("entity_id", F.explode("record_ids").alias("record_id")).join(truth, "record_id")
    by_seed = j.groupBy("entity_id", "seed").agg(F.count(F.lit(1)).alias("votes"))
    best = by_seed.groupBy("entity_id").agg(F.min_by("seed", F.struct(-F.col("votes"), "seed")).alias("seed"), F.max("votes").alias("votes"), F.count(F.lit(1)).alias("seeds"), F.sum("votes").alias("all"))
    return best.withColumn("purity", F.col("votes") / F.col("all")).drop("all")


def mapping_quality(mapping: DataFrame) -> DataFrame:
    """One row: resolved_entities_mapped, false_merges, fragmented_seed_entities (seeds of several entities), worst_fragmentation."""
    by_seed = mapping.groupBy("seed").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("seeds") > 1).alias("impure"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return by_seed.agg(
        count(F.sum("parts")).alias("resolved_entities_mapped"), count(F.sum("impure")).alias("false_merges"),
        F.count_if(F.col("parts") > 1).alias("fragmented_seed_entities"), count(F.max("parts")).alias("worst_fragmentation"),
    )


def lifted_labels(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """entity_id, label: the label of a seed (seed, label) for every entity that it fell into."""
    return mapping.select("entity_id", "seed").join(labels.select("seed", "label"), "seed").select("entity_id", "label")


def layering_confusion(assessed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 of the flagged entities, and the sorted lists flagged and missed."""
    j = assessed.select("entity_id", "flagged").join(labels.select("entity_id", "label"), "entity_id")
    hit, yes = F.col("flagged"), F.col("label")
    c = j.agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"),
        F.array_sort(F.collect_set(F.when(hit, F.col("entity_id")))).alias("flagged"), F.array_sort(F.collect_set(F.when(~hit & yes, F.col("entity_id")))).alias("missed"),
    )
    return prf(c)


def by_type(members: DataFrame, records: DataFrame) -> DataFrame:
    """members (cluster_id, record_id) with kind: the type of the cluster's least record, company if that is unknown."""
    kinds = members.join(records.select("record_id", "entity_type"), "record_id", "left")
    first = kinds.groupBy("cluster_id").agg(F.min_by("entity_type", "record_id").alias("kind"))
    return members.join(first.select("cluster_id", F.coalesce("kind", F.lit("company")).alias("kind")), "cluster_id")


def leakage(predicted: DataFrame, truth: DataFrame, members: DataFrame, candidates: DataFrame, share: float = 0.4, seed: int = 7) -> DataFrame:
    """split, leaked, tp, fp, fn, precision, recall, f1: the same predictions on the test half of both splits. leaked: records
    in both halves. truth: a, b; members: cluster_id, record_id; negatives are candidates among the half's records."""
    whole = cluster_level_split(members, share, seed).select("record_id", "half")
    a, b = whole.toDF("a", "half"), whole.toDF("b", "half_b")
    by_cluster = truth.select("a", "b").join(a, "a").join(b, "b").where("half = half_b").select("a", "b", "half")
    out = None
    for name, split in (("pair_level", pair_level_split(truth.select("a", "b"), share, seed)), ("cluster_level", by_cluster)):
        test = split.where("half = 'test'").select("a", "b")
        inside = test.select(F.explode(F.array("a", "b")).alias("record_id")).distinct()
        negative = negatives(candidates, truth, inside)
        guessed = predicted.select("a", "b").distinct()
        tp, fp = guessed.join(test, ["a", "b"], "left_semi"), guessed.join(negative, ["a", "b"], "left_semi")
        counts = tp.agg(F.count(F.lit(1)).alias("tp")).join(fp.agg(F.count(F.lit(1)).alias("fp"))).join(test.agg(F.count(F.lit(1)).alias("n"))).join(shared_records(split).agg(F.count(F.lit(1)).alias("leaked")))  # single rows
        row = prf(counts.select(F.lit(name).alias("split"), "leaked", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn")))
        out = row if out is None else out.unionByName(row)
    return out


def confident(text_rows: DataFrame, expected: str = "expected") -> DataFrame:
    """One row: probes, correct, rate: of probe texts with a verdict (passed) and the expected one."""
    c = text_rows.agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("passed") == F.col(expected)).alias("correct"))
    return c.withColumn("rate", F.when(F.col("probes") > 0, F.col("correct") / F.col("probes")).otherwise(0.0))


def gates(metrics: DataFrame, least: dict[str, float] = GATES) -> DataFrame:
    """metric, value -> metric, value, least, passed: a row for each gate; a missing metric fails."""
    g = metrics.sparkSession.createDataFrame(list(least.items()), "metric string, least double")
    return g.join(metrics, "metric", "left").select("metric", "value", "least", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)).alias("passed"))


@dataclass
class Version:
    version: int
    metrics: dict[str, float]
    stage: str = "candidate"
    gates: list[dict] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    notes: str = ""

    @property
    def passed(self) -> bool:
        return all(g["passed"] for g in self.gates)


class Registry:
    """Versions of a model in a JSON file on the driver. The results of the gates are kept with each version; one is promoted
    only if it passes all of them, or by force."""

    def __init__(self, path: str, least: dict[str, float] = GATES):
        self.path, self.least = Path(path), dict(least)
        self.versions = [Version(**v) for v in json.loads(self.path.read_text())] if self.path.exists() else []

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps([asdict(v) for v in self.versions], indent=1))

    def register(self, metrics: dict[str, float], params: dict | None = None, notes: str = "") -> Version:
        results = [{"gate": k, "minimum": x, "actual": metrics.get(k), "passed": metrics.get(k, float("-inf")) >= x} for k, x in self.least.items()]
        self.versions.append(Version(len(self.versions) + 1, dict(metrics), "candidate", results, dict(params or {}), notes))
        self.save()
        return self.versions[-1]

    def find(self, number: int) -> Version:
        for v in self.versions:
            if v.version == number:
                return v
        raise KeyError(f"there is no version {number}")

    def promote(self, number: int, to: str = "production", force: bool = False) -> dict:
        """What became of it: promoted, forced, and the gates that failed."""
        target = self.find(number)
        failed = [g["gate"] for g in target.gates if not g["passed"]]
        if failed and not force:
            return {"promoted": False, "version": number, "forced": False, "failed": failed}
        for other in self.versions:
            if other.stage == to and other is not target:
                other.stage = "archived"
        target.stage = to
        self.save()
        return {"promoted": True, "version": number, "forced": bool(failed), "failed": failed}

    def production(self) -> Version | None:
        return next((v for v in self.versions if v.stage == "production"), None)

    def compare(self, metrics: dict[str, float], tolerance: float = 0.01) -> dict:
        """Differences from the version in production, and those that fell by more than the tolerance."""
        now = self.production()
        if now is None:
            return {"baseline": None, "deltas": {}, "regressions": {}}
        deltas = {k: round(x - now.metrics[k], 4) for k, x in metrics.items() if k in now.metrics}
        return {"baseline": now.version, "deltas": deltas, "regressions": {k: d for k, d in deltas.items() if d < -tolerance}}

    def summary(self) -> dict:
        now = self.production()
        history = [{"version": v.version, "stage": v.stage, "passed": v.passed, "er_f1": v.metrics.get("er_f1")} for v in self.versions]
        return {"versions": len(self.versions), "production": now.version if now else None, "history": history}


def gate_report(v: Version) -> str:
    """A line for each gate of a version."""
    value = lambda x: "none" if x is None else f"{x:.4f}"
    return "\n".join([f"version {v.version}, {v.stage}", *(f"  {'pass' if g['passed'] else 'FAIL'} {g['gate']}: {value(g['actual'])}, at least {g['minimum']}" for g in v.gates)])
