"""The whole evaluation over registers whose truth is known: resolution, graph, retrieval, language, one screening, splits."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.sources import guidance, registers

from . import evaluation, language_gate, ownership, resolution, retrieval, screening
from .resolution import written

BASELINE_THRESHOLD = 0.85
AT = 5
PROBES = [
    ("The owner is a PEP, and that is an adverse finding.", False),
    ("The customer is politically exposed, so the relationship must be declined.", False),
    ("Her PEP status shows a risk of corruption.", False),
    ("A register lists the owner as a PEP. Enhanced due diligence is required; it is not an adverse finding.", True),
    ("The minister owns a third of it. Enhanced due diligence applies, and this is not an adverse finding.", True),
]


def load_world(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """record_id, seed: which records are of one entity; and seed, label: which seeds are layered structures."""
    w = spark.read.option("multiLine", True).schema("truth_clusters map<string,array<string>>, layered_roots map<string,boolean>").json(path)
    members = w.select(F.explode("truth_clusters").alias("seed", "ids")).select(F.explode("ids").alias("record_id"), "seed")
    return members, w.select(F.explode("layered_roots").alias("seed", "label"))


def split_experiments(scores: DataFrame, records: DataFrame, members: DataFrame, candidates: DataFrame, trials: int = 200) -> DataFrame:
    """model, split, precision, recall, f1 on the test half: weights fitted, and tokens memorised, on the train half of a
    split by pairs and of one by clusters. What a model gains by the split alone is what leaks."""
    truth = written(resolution.true_pairs(members))
    halves = evaluation.cluster_level_split(members, seed=7).select("record_id", "half")
    a, b = halves.toDF("a", "half"), halves.toDF("b", "half_b")
    splits = {"pair_level": evaluation.pair_level_split(truth), "cluster_level": truth.join(a, "a").join(b, "b").where("half = half_b").select("a", "b", "half")}
    named = records.select("record_id", evaluation.significant(F.col("name")).alias("tokens"))
    left, right = named.toDF("a", "a_tokens"), named.toDF("b", "b_tokens")
    out = None
    for name, split in splits.items():
        parts = {}
        for half in ("train", "test"):
            positive = split.where(F.col("half") == half).select("a", "b")
            inside = positive.select(F.explode(F.array("a", "b")).alias("record_id")).distinct()
            negative = evaluation.negatives(candidates, truth, inside)
            parts[half] = written(positive.withColumn("label", F.lit(True)).unionByName(negative.withColumn("label", F.lit(False))))
        best = evaluation.weights_of(evaluation.fit(scores.join(parts["train"], ["a", "b"]), trials), trials)
        by_score = scores.where(evaluation.rescore(best["weights"]) >= best["match_threshold"]).select("a", "b")
        tokens = evaluation.memorised_tokens(parts["train"].join(left, "a").join(right, "b"))
        by_token = evaluation.memoriser_predict(parts["test"].join(left, "a").join(right, "b"), tokens)
        for model, predicted in (("weights", by_score), ("tokens", by_token)):
            test = parts["test"].join(predicted.distinct().withColumn("hit", F.lit(True)), ["a", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
            c = test.agg(F.count_if(F.col("hit") & F.col("label")).alias("tp"), F.count_if(F.col("hit") & ~F.col("label")).alias("fp"), F.count_if(~F.col("hit") & F.col("label")).alias("fn"))
            row = ownership.prf(c).select(F.lit(model).alias("model"), F.lit(name).alias("split"), "precision", "recall", "f1")
            out = row if out is None else out.unionByName(row)
    return out


def ablation(sections: DataFrame, golden: DataFrame, k: int = AT) -> DataFrame:
    """step, recall, precision, mrr of the golden questions (qid, question, primary) after each step of retrieval."""
    relevant = golden.select(F.col("qid").alias("query"), F.explode("primary").alias("doc"))
    out = None
    for step, ranked in guidance.rankings(sections, golden.select(F.col("qid").alias("query"), "question")).items():
        row = retrieval.retrieval_metrics(ranked, relevant, k).withColumn("step", F.lit(step))
        out = row if out is None else out.unionByName(row)
    return out


def full_evaluation(spark: SparkSession, folder: str, world: str, guidance_file: str, golden_file: str, out: str | None = None) -> dict:
    """The report, which is written as JSON if out names a file on the driver. Every entry is one row or a few."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  single rows and short tables
    records, statements = (written(x) for x in registers.load_all(spark, folder))
    members, labelled = (written(x) for x in load_world(spark, world))
    clusters = members.select(F.col("seed").alias("cluster_id"), "record_id")
    truth = written(resolution.true_pairs(clusters))
    candidates = written(resolution.candidate_pairs(resolution.blocking_keys(records)))
    scores = written(resolution.score_pairs(records, candidates))
    rulings = written(resolution.adjudicate(scores))
    accepted = written(resolution.accepted_pairs(scores, rulings))
    entities = written(resolution.entities(records, accepted))
    mapping = written(evaluation.majority_seed(entities, members))
    nodes, bridge = written(screening.nodes_of(entities)), resolution.record_to_entity(entities)
    edges = written(ownership.edges(statements, entities, bridge))
    labels = written(evaluation.lifted_labels(mapping, labelled))
    assessed = written(ownership.assess(ownership.features(nodes, edges, labels.select(F.col("entity_id").alias("root")))))
    sections, golden = written(guidance.sections(spark, guidance_file)), written(guidance.golden(spark, golden_file))
    probes = language_gate.language_check(spark.createDataFrame(PROBES, "text string, expected boolean"))
    subject = screening.pick_subject(nodes, edges)
    state = screening.screen(spark, subject, {"records": records, "statements": statements, "entities": entities, "sections": sections})
    found = evaluation.pair_metrics(accepted, truth)
    baseline = evaluation.pair_metrics(scores.where(F.col("name_jaro") >= BASELINE_THRESHOLD), truth)
    report = {
        "corpus": {"by_source": rows(registers.source_counts(records)), "true_pairs": truth.count(), "statements": statements.count()},
        "entity_resolution": {"candidate_recall": rows(resolution.candidate_recall(candidates, truth))[0], "pipeline": rows(found)[0], "names_only": rows(baseline)[0], "rulings": rows(resolution.ruling_counts(scores, rulings))[0], "clusters": rows(resolution.cluster_summary(entities))[0], "mapping": rows(evaluation.mapping_quality(mapping))[0]},
        "graph": {"stats": rows(screening.graph_stats(nodes, edges))[0], "layering": rows(evaluation.layering_confusion(assessed, labels))[0], "sweep": rows(ownership.threshold_sweep(assessed, labels).orderBy("threshold"))[::4]},
        "retrieval": {r["step"]: r for r in rows(ablation(sections, golden))},
        "language": rows(evaluation.confident(probes))[0],
        "workflow": {"subject": subject, "path": state["visited"], "verification": state["verification"], "recommendation": state["decision_package"]["recommendation"], "awaiting_human_decision": state["awaiting_human_decision"]},
        "experiments": rows(split_experiments(scores, records, clusters, candidates)),
    }
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(json.dumps(report, indent=1, default=str))
    return report


def metrics_for_registry(report: dict) -> dict[str, float]:
    """The values that the promotion gates ask for, by their names."""
    er, steps = report["entity_resolution"], report["retrieval"]
    return {
        "er_f1": er["pipeline"]["f1"], "er_precision": er["pipeline"]["precision"], "candidate_recall": er["candidate_recall"]["recall"],
        "layering_precision": report["graph"]["layering"]["precision"], "recall_at_5": steps["reranked"]["recall"],
        "citation_resolution": report["workflow"]["verification"]["citations"]["rate"], "language_gate": report["language"]["rate"],
    }
