"""The eight steps, decisions, and the evaluation around them, over generated registers."""

import json

import pytest
from pyspark.sql import functions as F

from lanternflow import cli
from lanternflow.operators import evaluation, language_gate, ownership, resolution, screening
from lanternflow.operators.workflow import WorkflowError, record_decision
from lanternflow.sources import registers, synthetic

SECTIONS = [("FATF-R10", "FATF", "Beneficial ownership", "Identify the beneficial owner above the ownership threshold."), ("FATF-R12", "FATF", "Politically exposed persons", "Enhanced due diligence; not a reason to decline."), ("CDD-1", "FinCEN", "Indirect ownership", "Ownership is calculated through intermediate entities."), ("FFIEC-1", "FFIEC", "Concealment", "Techniques of concealment: chains across jurisdictions, nominee shareholder.")]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("world")
    truth = synthetic.generate(str(folder / "r"), 15, 20)
    (folder / "g.json").write_text(json.dumps({"sections": [dict(zip(("id", "source", "title", "text"), s, strict=True)) for s in SECTIONS]}))
    records, statements = registers.load_all(spark, f"file://{folder / 'r'}")
    records, statements = resolution.written(records), resolution.written(statements)
    entities, nodes, edges = cli.graph_of(records, statements)
    return {"folder": f"file://{folder / 'r'}", "guidance": f"file://{folder / 'g.json'}", "truth": truth, "records": records, "statements": statements, "entities": entities, "nodes": resolution.written(nodes), "edges": edges}


def given(world):
    return {k: world[k] for k in ("records", "statements", "entities")}


def test_eight_steps_stop_for_a_decision(spark, world):
    subject = screening.pick_subject(world["nodes"], world["edges"])
    state = screening.screen(spark, subject, given(world), guidance_file=world["guidance"])
    assert state["visited"] == ["ingest", "resolve", "assemble_graph", "score_structure", "retrieve_guidance", "draft_memo", "verify", "human_gate"]
    package = state["decision_package"]
    assert state["awaiting_human_decision"] and package["decision"] is None and package["requires_human_decision"] and package["subject"] == subject
    assert state["verification"]["citations"]["rate"] == 1.0 and state["verification"]["citations"]["cited"] > 0 and state["verification"]["passed"]
    assert state["guidance_queries"][0] == screening.ALWAYS and {r.section_id for r in state["guidance"].collect()} <= {s[0] for s in SECTIONS}
    closed = record_decision(state, "clear", "an analyst", "today", "seen")
    assert closed["decision_package"]["decided_by"] == "an analyst" and not closed["awaiting_human_decision"] and state["awaiting_human_decision"]
    with pytest.raises(WorkflowError):
        record_decision(state, "approve", "an analyst", "today")


def test_unknown_subject_goes_by_the_other_way(spark, world):
    state = screening.screen(spark, "E-none", given(world), guidance_file=world["guidance"])
    assert state["visited"][-2:] == ["cannot_score", "human_gate"] and state["decision_package"]["recommendation"] == "cannot assess"


def test_pause_and_resume(spark, world):
    w = screening.build(spark, guidance_file=world["guidance"], pausing=True)
    paused = w.run({**given(world), "subject": "E-none"})
    assert paused["paused"] == "human_gate" and "decision" not in paused
    done = w.resume(paused, "escalate", "an analyst", "today")
    assert done["visited"][-1] == "human_gate" and done["decision_package"]["decision"] == "escalate" and not done["awaiting_human_decision"]


def test_screen_command(spark, world, capsys):
    subject = screening.pick_subject(world["nodes"], world["edges"])
    cli.main(["screen", subject, "--registers", world["folder"], "--guidance", world["guidance"], "--decide", "escalate", "--analyst", "me"])
    said = json.loads(capsys.readouterr().out)
    assert said["decision"] == "escalate" and said["decided_by"] == "me" and said["path"][-1] == "human_gate"
    cli.main(["workflow"])
    assert "score_structure -->|scored| retrieve_guidance" in capsys.readouterr().out


def test_truth_and_confusion(spark, world):
    truth = spark.createDataFrame([(x, k) for k, v in world["truth"].items() for x in v], "record_id string, seed string")
    mapping = evaluation.majority_seed(world["entities"], truth)
    q = evaluation.mapping_quality(mapping).first()
    assert q.resolved_entities_mapped == world["entities"].count() and q.worst_fragmentation >= 1 and q.false_merges == mapping.where("purity < 1").count()
    seeds = sorted(world["truth"])
    labels = evaluation.lifted_labels(mapping, spark.createDataFrame([(s, i % 2 == 0) for i, s in enumerate(seeds)], "seed string, label boolean"))
    assessed = labels.select("entity_id", (F.crc32("entity_id") % 3 == 0).alias("flagged"))
    c = evaluation.layering_confusion(assessed, labels).first()
    assert c.tp + c.fp + c.fn + c.tn == labels.count() and len(c.flagged) == c.tp + c.fp and len(c.missed) == c.fn
    stats = screening.graph_stats(world["nodes"], world["edges"]).first()
    assert stats.nodes == world["nodes"].count() and stats.edges == world["edges"].count() >= stats.control_edges and stats.unresolved_statements == 0


def test_leakage(spark):
    members = spark.createDataFrame([(f"c{i}", f"r{i}-{j}") for i in range(40) for j in range(3)], "cluster_id string, record_id string")
    truth = resolution.true_pairs(members)
    rows = {r.split: r for r in evaluation.leakage(truth, truth, members, truth).collect()}
    assert rows["pair_level"].leaked > 0 == rows["cluster_level"].leaked and rows["pair_level"].recall == rows["cluster_level"].recall == 1.0
    kinds = evaluation.by_type(members, spark.createDataFrame([("r0-0", "person")], "record_id string, entity_type string"))
    assert kinds.where("kind = 'person'").count() == 3 and kinds.count() == 120


def test_language_probes(spark):
    probes = [("The owner is a PEP, which is an adverse finding.", False), ("The customer is politically exposed and must be declined.", False), ("The minister requires enhanced due diligence; this is not an adverse finding.", True)]
    rows = language_gate.language_check(spark.createDataFrame(probes, "text string, expected boolean"))
    assert evaluation.confident(rows).first().rate == 1.0


def test_capped_paths_of_a_dense_graph_end(spark):
    n = 20
    rows = [(str(i), str(j), "shareholding", 50.0, 1.0, 1, i * n + j) for i in range(n) for j in range(n) if i != j]
    e = spark.createDataFrame(rows, "parent string, child string, interest_type string, share_percent double, confidence double, n_statements long, edge_seq long")
    got = [tuple(r.trail) for r in ownership.paths(e, spark.createDataFrame([("0",)], "root string")).orderBy("trail").collect()]
    want = []

    def walk(node: int, seen: set[int], trail: tuple[int, ...]) -> None:
        for child in range(n):
            if len(want) >= ownership.PATH_LIMIT:
                return
            if child not in seen and len(trail) < ownership.MAX_DEPTH:
                want.append((*trail, node * n + child))
                walk(child, seen | {child}, want[-1])

    walk(0, {0}, ())
    assert got == sorted(want)


def test_load_order_holds_for_many_partitions(spark):
    a = spark.range(0, 400, 1, 400).select(F.lit("x").alias("record_id"), F.lit("first").alias("source"), registers.in_order(0).alias("load_seq"))
    b = spark.range(0, 4, 1, 4).select(F.lit("x").alias("record_id"), F.lit("second").alias("source"), registers.in_order(1).alias("load_seq"))
    assert registers.first_wins(b.unionByName(a)).first().source == "first"
    assert [r.n for r in registers.numbered(spark.range(0, 50, 1, 7)).orderBy("id").collect()] == list(range(50))


def test_control_roots_ignore_other_ties(spark):
    e = spark.createDataFrame([("P", "A", "shareholding"), ("D", "P", "directorship"), ("A", "B", "shareholding")], "parent string, child string, interest_type string")
    assert [r.root for r in cli.control_roots(e).collect()] == ["P"]


def test_full_evaluation(spark, world, tmp_path, capsys):
    seeds = sorted(world["truth"])
    (tmp_path / "w.json").write_text(json.dumps({"truth_clusters": world["truth"], "layered_roots": {s: i % 3 == 0 for i, s in enumerate(seeds)}}))
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"qid": "q1", "question": "beneficial ownership threshold", "primary": ["FATF-R10"], "secondary": []}, {"qid": "q2", "question": "politically exposed person", "primary": ["FATF-R12"], "secondary": []}]}))
    place = lambda n: f"file://{tmp_path / n}"
    cli.main(["eval", "--registers", world["folder"], "--world", place("w.json"), "--guidance", world["guidance"], "--golden", place("q.json"), "--registry", str(tmp_path / "r.json"), "--out", str(tmp_path / "report.json")])
    said, found = capsys.readouterr().out, json.loads((tmp_path / "report.json").read_text())
    assert "pass er_precision" in said and "pass citation_resolution" in said and "pass language_gate" in said
    assert found["entity_resolution"]["pipeline"]["f1"] > 0.8 and found["entity_resolution"]["names_only"]["f1"] > 0
    assert {r["step"] for r in found["retrieval"].values()} == {"bm25", "dense", "fused", "reranked"} and found["retrieval"]["reranked"]["recall"] == 1.0
    assert {(r["model"], r["split"]) for r in found["experiments"]} == {(m, s) for m in ("weights", "tokens") for s in ("pair_level", "cluster_level")}
    assert found["workflow"]["path"][-1] == "human_gate" and evaluation.Registry(str(tmp_path / "r.json")).summary()["versions"] == 1


def test_scores_are_explained(spark):
    row = {k: 0.0 for k in evaluation.WEIGHTS} | {"name_jaro": 1.0, "jurisdiction_match": -0.5}
    s = spark.createDataFrame([("a", "b", 0.3, "reject", *row.values())], "a string, b string, score double, decision string, " + ", ".join(f"{k} double" for k in row))
    assert resolution.explained(s).first().text == "score 0.300, reject: name_jaro 1.00 (+0.340), jurisdiction_match -0.50 (-0.040)"
    texts = spark.createDataFrame([("The PEP is corrupt.",), ("Fine.",)], "text string")
    c = language_gate.gate_counts(language_gate.language_check(texts)).first()
    assert (c.documents, c.mentioning, c.passing, c.rate) == (2, 1, 0, 0.0) and c.violations >= 1
