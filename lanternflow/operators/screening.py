"""The eight steps of screening one subject, up to the human gate: ingest, resolve, assemble the graph, score its structure,
retrieve guidance, draft the memo, verify it, stop for a decision."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.sources import guidance, registers

from . import language_gate, memo, ownership, resolution
from .workflow import END, State, Workflow

TOP_GUIDANCE = 5
LEAST_RESOLVED = 0.99
# What is asked of the guidance, always and where an indicator fired.
ALWAYS = "beneficial ownership identification threshold"
ASKED = [
    (lambda f: f["chain_depth"] >= 3, "indirect ownership calculated through intermediate entities"),
    (lambda f: f["secrecy_hops"] or f["secrecy_co_owners"], "concealment techniques chains across jurisdictions"),
    (lambda f: f["nominee_intermediaries"], "nominee shareholder corporate service provider on whose instructions"),
    (lambda f: f["in_cycle"], "complex structures circular holdings"),
    (lambda f: f["sub_threshold_holdings"], "fragmentation of holdings below the disclosure threshold"),
]
ASKED_OF_PEPS = "politically exposed person enhanced due diligence not a reason to decline"
ASKED_OF_SANCTIONED = "fifty percent rule aggregate ownership blocked entity"


class MemoWriter(Protocol):
    """What drafts memos: memo_id and text for entities, their assessments, chains and guidance."""

    def __call__(self, entities: DataFrame, assessed: DataFrame, chains: DataFrame, guidance: DataFrame) -> DataFrame: ...


def nodes_of(entities: DataFrame) -> DataFrame:
    """entity_id, canonical_name, entity_type, jurisdiction (the first by name), n_sources, weakest_link."""
    jurisdiction = F.coalesce(F.try_element_at("jurisdictions", F.lit(1)), F.lit(""))
    return entities.select("entity_id", "canonical_name", "entity_type", jurisdiction.alias("jurisdiction"), F.size("sources").alias("n_sources"), "weakest_link")


def graph_stats(nodes: DataFrame, e: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, control_edges, roots, cycles, unresolved_statements, mean_edge_confidence, secrecy_nodes."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    mean = F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_edge_confidence")
    edges = e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("interest_type").isin(ownership.CONTROL_KINDS)).alias("control_edges"), mean)
    own = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("jurisdiction").isin(ownership.SECRECY)).alias("secrecy_nodes"))
    left = count(unresolved, "unresolved_statements") if unresolved is not None else nodes.sparkSession.createDataFrame([(0,)], "unresolved_statements long")
    parts = [edges, count(ownership.roots(nodes, e), "roots"), count(ownership.cycles(e), "cycles"), left]
    out = own
    for part in parts:
        out = out.join(part)  # single rows
    return out.select("nodes", "edges", "control_edges", "roots", "cycles", "unresolved_statements", "mean_edge_confidence", "secrecy_nodes")


def questions_for(features: dict, is_pep: bool, is_sanctioned: bool) -> list[str]:
    """What to ask of the guidance: it depends on the shape that was found, not on the name of the subject."""
    asked = [ALWAYS, *(text for test, text in ASKED if test(features))]
    return asked + [ASKED_OF_PEPS] * is_pep + [ASKED_OF_SANCTIONED] * is_sanctioned


def build(spark: SparkSession, folder: str = "", guidance_file: str = "", threshold: float = ownership.RISK_THRESHOLD, pausing: bool = False, writer: MemoWriter = memo.memos) -> Workflow:
    """The workflow. State: subject (an entity id); records, statements, entities, nodes, edges and sections may be given and
    are else made from folder and guidance_file. With pausing the walk stops before the gate until there is a decision."""

    def ingest(state: State) -> State:
        sections = {} if "sections" in state else {"sections": guidance.sections(spark, guidance_file)}
        if "entities" in state or "records" in state:
            return sections
        records, statements = registers.load_all(spark, folder)
        return sections | {"records": resolution.written(records), "statements": resolution.written(statements)}

    def resolve(state: State) -> State:
        return {} if "entities" in state else {"entities": resolution.written(resolution.resolve(state["records"]))}

    def assemble_graph(state: State) -> State:
        if "edges" in state:
            return {} if "nodes" in state else {"nodes": nodes_of(state["entities"])}
        bridge = resolution.record_to_entity(state["entities"])
        nodes, edges = nodes_of(state["entities"]), resolution.written(ownership.edges(state["statements"], state["entities"], bridge))
        unresolved = ownership.lifted(state["statements"], bridge).where(F.col("reason").isNotNull())
        return {"nodes": nodes, "edges": edges, "graph_stats": graph_stats(nodes, edges, unresolved)}

    def score_structure(state: State) -> State:
        target = state["nodes"].where(F.col("entity_id") == state["subject"]).select(F.col("entity_id").alias("root"))
        if not target.limit(1).count():
            return {"error": f"{state['subject']} is no entity of the graph", "features": None, "assessed": None}
        features = resolution.written(ownership.features(state["nodes"], state["edges"], target))
        assessed = ownership.assess(features, threshold)
        return {"features": features, "assessed": assessed, "chain": memo.chain_view(state["nodes"], state["edges"], target)}

    def retrieve_guidance(state: State) -> State:
        entity = state["entities"].where(F.col("entity_id") == state["subject"]).select("is_pep", "is_sanctioned").first()
        asked = questions_for(state["features"].first().asDict(), bool(entity["is_pep"]), bool(entity["is_sanctioned"]))
        found = guidance.search(state["sections"], spark.createDataFrame(list(enumerate(asked)), "query int, question string")).where(F.col("rank") <= TOP_GUIDANCE)
        # each section once, at its first place over the questions in their order
        first = found.groupBy("doc").agg(F.min(F.struct("query", "rank")).alias("at"))
        titled = first.join(state["sections"].select(F.col("id").alias("doc"), "title"), "doc")
        ranked = titled.select(F.lit(state["subject"]).alias("entity_id"), (F.col("at.query") * TOP_GUIDANCE + F.col("at.rank")).alias("rank"), F.col("doc").alias("section_id"), "title")
        return {"guidance": resolution.written(ranked), "guidance_queries": asked}

    def draft_memo(state: State) -> State:
        entity = state["entities"].where(F.col("entity_id") == state["subject"])
        drafted = language_gate.language_check(writer(entity, state["assessed"], state["chain"], state["guidance"]))
        pep = drafted.join(entity.select(F.col("entity_id").alias("memo_id"), "is_pep"), "memo_id")
        return {"memo": resolution.written(pep.select("memo_id", language_gate.enforced(F.col("text"), F.col("is_pep") | F.col("pep_mentioned"), F.col("framing_present")).alias("text")))}

    def verify(state: State) -> State:
        valid = state["edges"].select(F.explode("statements").alias("id")).unionByName(state["sections"].select("id"))
        cited = language_gate.verify_citations(state["memo"], valid).first().asDict()
        spoken = language_gate.language_check(state["memo"]).first()
        return {"verification": {"citations": cited, "language_passed": spoken["passed"], "passed": cited["rate"] >= LEAST_RESOLVED and spoken["passed"]}}

    def cannot_score(state: State) -> State:
        return {"decision_package": {"subject": state["subject"], "recommendation": "cannot assess", "error": state["error"], "requires_human_decision": True, "decision": None}}

    def human_gate(state: State) -> State:
        package = state.get("decision_package")
        if package is None:
            found = state["assessed"].first()
            package = {
                "subject": state["subject"],
                "recommendation": "escalate for analyst review" if found["flagged"] else "no escalation indicated",
                "structural_score": round(found["score"], 4),
                "threshold": threshold,
                "reasons": list(found["reasons"]),
                "verification_passed": state["verification"]["passed"],
                "requires_human_decision": True,
                "decision": None,
                "decided_by": None,
                "decided_at": None,
            }
        taken = state.get("decision")
        if taken:
            package = package | {"decision": taken["decision"], "decided_by": taken["analyst"], "decided_at": taken["at"], "note": taken["note"], "requires_human_decision": False}
        return {"decision_package": package, "awaiting_human_decision": not taken}

    steps = [ingest, resolve, assemble_graph, score_structure, retrieve_guidance, draft_memo, verify, human_gate, cannot_score]
    edges = {"ingest": "resolve", "resolve": "assemble_graph", "assemble_graph": "score_structure", "retrieve_guidance": "draft_memo", "draft_memo": "verify", "verify": "human_gate", "cannot_score": "human_gate", "human_gate": END}
    return Workflow(
        "ingest", {f.__name__: f for f in steps}, edges, {"score_structure": lambda s: "scored" if s["assessed"] is not None else "unscoreable"},
        required=("human_gate",), gate="human_gate" if pausing else "", ways={"score_structure": {"scored": "retrieve_guidance", "unscoreable": "cannot_score"}},
    )


def screen(spark: SparkSession, subject: str, state: State | None = None, **settings) -> State:
    """The state after all steps; a decision is still to be taken (workflow.record_decision)."""
    return build(spark, **settings).run({**(state or {}), "subject": subject})


def pick_subject(nodes: DataFrame, e: DataFrame) -> str | None:
    """The first person that controls something, else the first controlling entity, else any entity."""
    holders = ownership.control(e).select(F.col("parent").alias("entity_id")).distinct().withColumn("holds", F.lit(1))
    order = [F.coalesce("holds", F.lit(0)).desc(), (F.col("entity_type") == "person").desc(), F.col("entity_id")]
    found = nodes.join(holders, "entity_id", "left").orderBy(*order).select("entity_id").first()
    return found and found["entity_id"]
