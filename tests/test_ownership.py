import itertools
import random

from lanternflow.operators import drift, evaluation, language_gate, ownership, retrieval
from lanternflow.operators.workflow import Workflow, WorkflowError, audit_trail, record_decision, to_mermaid
from pyspark.sql import functions as F

import pytest


def edges(spark, rows):
    return spark.createDataFrame([(p, c, k, s, 1.0, 1, i) for i, (p, c, k, s) in enumerate(rows)], "parent string, child string, interest_type string, share_percent double, confidence double, n_statements bigint, edge_seq bigint")


def test_chain(spark):
    e = edges(spark, [("P", "A", "shareholding", 100.0), ("A", "B", "shareholding", 50.0), ("B", "C", "shareholding", 60.0)])
    nodes = spark.createDataFrame([("P", "p", "RU"), ("A", "a", "VG"), ("B", "b", "KY"), ("C", "c", "GB")], "entity_id string, canonical_name string, jurisdiction string")
    assert [r[0] for r in ownership.roots(nodes, e).collect()] == ["P"]
    start = spark.createDataFrame([("P",)], "root string")
    held = {r.child: r.effective for r in ownership.effective_shares(ownership.paths(e, start)).collect()}
    assert held == {"A": 100.0, "B": 50.0, "C": 30.0}
    f = ownership.features(nodes, e, start).collect()[0]
    assert (f.chain_depth, f.secrecy_hops, f.in_cycle, f.controlled_count, f.jurisdiction_hops, f.ownership_attenuation) == (3.0, 2.0, 0.0, 3.0, 3.0, 70.0)
    assert ownership.assess(ownership.features(nodes, e, start)).collect()[0].reasons


def test_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = "ABCDEF"
        rows = sorted({(a, b, "shareholding", 50.0) for a, b in itertools.permutations(names, 2) if rng.random() < 0.3})
        e = edges(spark, rows)
        out = {}
        for a, b, *_ in rows:
            out.setdefault(a, []).append(b)

        def walk(path):
            for b in out.get(path[-1], []):
                if b not in path:
                    yield (*path, b)
                    yield from walk((*path, b))

        want = sorted(p for n in names for p in walk((n,)))
        starts = spark.createDataFrame([(n,) for n in names], "root string")
        assert sorted(tuple(r.nodes) for r in ownership.paths(e, starts, 12, None).collect()) == want
        circles = {tuple(sorted(p)) for p in want if p[0] in out.get(p[-1], [])}
        assert {tuple(r.nodes) for r in ownership.cycles(e).collect()} == circles
        assert {(r.root, r.node) for r in ownership.descendants(e, starts).collect()} == {(p[0], p[-1]) for p in want}


def test_no_edges(spark):
    e = edges(spark, [("A", "B", "directorship", 0.0)])
    starts = spark.createDataFrame([("A",)], "root string")
    assert ownership.paths(e, starts).count() == 0 and ownership.cycles(e).count() == 0 and ownership.descendants(e, starts).count() == 1


def test_corroboration_and_lift(spark):
    s = spark.createDataFrame([("s1", "rB", "rA", "ownership", 40.0, 0.9, 0), ("s2", "rB", "rA", "ownership", 60.0, 1.0, 1), ("s3", "rB", "rX", "ownership", 1.0, 1.0, 2)], "statement_id string, subject_record_id string, interested_record_id string, interest_type string, share_percent double, confidence double, stmt_seq bigint")
    entities = spark.createDataFrame([("A", 0.6), ("B", 1.0)], "entity_id string, weakest_link double")
    bridge = spark.createDataFrame([("rA", "A"), ("rB", "B")], "record_id string, entity_id string")
    e = ownership.edges(s, entities, bridge).collect()
    assert len(e) == 1 and e[0].share_percent == 60.0 and e[0].confidence == 0.6 and e[0].statements == ["s1", "s2"]
    assert ownership.lifted(s, bridge).where("reason is not null").count() == 1


def test_retrieval(spark):
    d = spark.createDataFrame([("twenty-five percent",), ("25 percent",), ("Exit all",), (None,)], "t string").select(retrieval.tokenize(F.col("t")).alias("w")).collect()
    assert "25" in d[0].w and "twenty" in d[1].w and d[2].w == ["exit", "terminate", "terminating", "all", "entire"] and d[3].w == []
    lists = [spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(r)], "query int, doc string, rank int") for r in ("ab", "bc")]
    assert retrieval.top_k(retrieval.rrf(lists, 10), 1).collect()[0].doc == "b"
    index = retrieval.DenseIndex({"x": ["owner", "control"], "y": ["report", "filing"], "z": ["owner", "filing"]})
    assert index.search(["owner", "control"], 1)[0][0] == "x"
    r = spark.createDataFrame([("what does fincen say",), ("recommendation 12",), ("nothing",)], "q string").select(retrieval.infer_regime(F.col("q"))).collect()
    assert [x[0] for x in r] == ["FinCEN", "FATF", None]


def test_gate_and_citations(spark):
    t = ["A PEP match. Refer for enhanced due diligence; it is not an adverse finding.", "The PEP is corrupt and must be declined.", "Weather is fine.", "The minister was never guilty of fraud."]
    r = language_gate.language_check(spark.createDataFrame(list(enumerate(t)), "i int, text string")).orderBy("i").collect()
    assert [x.passed for x in r] == [True, False, True, False] and r[1].n_violations == 2
    m = spark.createDataFrame([(1, "As [reg:FATF-R10] and [see figure 2] say [cite:none]."), (2, "")], "memo_id int, text string")
    v = {x.memo: x for x in language_gate.verify_citations(m, spark.createDataFrame([("FATF-R10",)], "id string")).collect()}
    assert (v[1].cited, v[1].unresolved, v[1].rate, v[2].rate) == (2, 1, 0.5, 1.0)


def test_drift_and_gates(spark):
    base = spark.createDataFrame([("GB", "x", "a b")] * 8 + [("US", "y", "long name here")] * 2, "jurisdiction string, source string, name string")
    assert all(abs(r.value) < 1e-9 for r in drift.run_monitors(base, base).collect())
    moved = drift.simulate_designation_round(base, "US", 9)
    assert {r.overall for r in drift.run_monitors(base, moved).collect()} == {"alert"}
    g = evaluation.gates(spark.createDataFrame([("er_f1", 0.95), ("er_precision", 0.5)], "metric string, value double"))
    assert {r.metric for r in g.collect() if r.passed} == {"er_f1"}


def test_registry(tmp_path):
    r = evaluation.Registry(str(tmp_path / "r.json"))
    r.register({k: 1.0 for k in evaluation.GATES})
    r.register({k: 1.0 for k in evaluation.GATES} | {"er_f1": 0.1})
    assert r.promote(1)["promoted"] and r.promote(2) == {"promoted": False, "version": 2, "forced": False, "failed": ["er_f1"]}
    again = evaluation.Registry(str(tmp_path / "r.json"))
    assert again.versions[0].stage == "production" and again.versions[1].gates[0] == {"gate": "er_f1", "minimum": 0.9, "actual": 0.1, "passed": False}
    assert again.compare({"er_f1": 0.5, "new": 1.0}) == {"baseline": 1, "deltas": {"er_f1": -0.5}, "regressions": {"er_f1": -0.5}}
    with pytest.raises(KeyError):
        r.promote(0)
    assert r.promote(2, force=True)["forced"] and r.production().version == 2 and r.versions[0].stage == "archived"
    assert r.summary()["production"] == 2 and "FAIL er_f1: 0.1000, at least 0.9" in evaluation.gate_report(r.versions[1])


def test_workflow(spark):
    w = Workflow("a", {"a": lambda s: {"x": 1}, "gate": lambda s: {}, "b": lambda s: {"y": s["x"]}}, {"a": "gate", "gate": "b", "b": "end"}, required=("gate",), gate="gate")
    paused = w.run({})
    assert paused["paused"] == "gate"
    with pytest.raises(WorkflowError):
        record_decision(paused, "maybe", "someone", "today")
    done = w.run(record_decision(paused, "clear", "someone", "today"))
    assert done["y"] == 1 and audit_trail(spark, done).count() == 3
    with pytest.raises(WorkflowError):
        Workflow("a", {"a": lambda s: s}).validate()
    again = w.run({})
    assert w.resume(again, "escalate", "someone", "later")["decision"]["decision"] == "escalate" and len(w.history()) == 1 + 2 + 1 + 2
    with pytest.raises(WorkflowError):
        w.resume(done, "clear", "someone", "later")
    routed = Workflow("a", {"a": lambda s: {}, "b": lambda s: {}}, {"b": "end"}, {"a": lambda s: "yes"}, ways={"a": {"yes": "b", "no": "end"}})
    assert routed.run({})["visited"] == ["a", "b"] and "a -->|no| end" in to_mermaid(routed)
    with pytest.raises(WorkflowError):
        Workflow("a", {"a": lambda s: {}}, {}, {"a": lambda s: "yes"}, ways={"a": {"yes": "missing"}}).validate()
