"""Commands: registers, resolve, graph, rank, screen, guidance, drift, eval, registry, workflow. Each prints a small table or
writes Parquet with --out."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.operators import drift, evaluation, ownership, report, resolution, screening, workflow
from lanternflow.sources import guidance, registers


def graph_of(records: DataFrame, statements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, nodes (entity_id, canonical_name, jurisdiction, ...) and edges."""
    entities = resolution.written(resolution.resolve(records))
    return entities, screening.nodes_of(entities), resolution.written(ownership.edges(statements, entities, resolution.record_to_entity(entities)))


def control_roots(edges: DataFrame) -> DataFrame:
    """root: who controls something and is controlled by nobody; other ties into it, as a directorship, don't count."""
    c = ownership.control(edges)
    return c.select(F.col("parent").alias("root")).distinct().join(c.select(F.col("child").alias("root")).distinct(), "root", "left_anti")


def decided(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Screens one entity, with a decision if there is one, and gives its package with the path that was walked."""
    state = screening.screen(spark, a.entity, folder=a.registers, guidance_file=a.guidance)
    if a.decide:
        state = workflow.record_decision(state, a.decide, a.analyst, a.at, a.note)
    return {"path": state["visited"], "verification": state.get("verification"), **state["decision_package"]}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lanternflow", description=__doc__)
    p.add_argument("command", choices=["registers", "resolve", "graph", "rank", "screen", "guidance", "drift", "eval", "registry", "workflow"])
    p.add_argument("entity", nargs="?", help="the entity to screen")
    p.add_argument("--registers", help="folder of the nine register files")
    p.add_argument("--guidance", help="the guidance file")
    p.add_argument("--registry", default="registry.json", help="file of the model registry")
    p.add_argument("--world", help="the truth of generated registers")
    p.add_argument("--golden", help="the golden questions")
    p.add_argument("--question", default="")
    p.add_argument("--simulate", help="jurisdiction of a simulated designation round")
    p.add_argument("--decide", choices=workflow.DECISIONS)
    p.add_argument("--analyst", default="")
    p.add_argument("--at", default="", help="time of the decision")
    p.add_argument("--note", default="")
    p.add_argument("--out")
    a = p.parse_args(argv)
    if a.command == "registry":
        print(json.dumps(evaluation.Registry(a.registry).summary(), indent=1))
        return
    spark = SparkSession.builder.appName("lanternflow").getOrCreate()
    if a.command == "workflow":
        print(workflow.to_mermaid(screening.build(spark)))
        return
    if a.command == "eval":
        found = report.full_evaluation(spark, a.registers, a.world, a.guidance, a.golden, a.out)
        version = evaluation.Registry(a.registry).register(report.metrics_for_registry(found))
        print(evaluation.gate_report(version))
        return
    if a.command == "screen":
        print(json.dumps(decided(spark, a), indent=1, default=str))
        return
    if a.command == "guidance":
        result = guidance.search(guidance.sections(spark, a.guidance), spark.createDataFrame([(1, a.question)], "query int, question string"))
    else:
        records, statements = registers.load_all(spark, a.registers)
        records, statements = resolution.written(records), resolution.written(statements)
        if a.command == "registers":
            result = registers.source_counts(records)
        elif a.command == "resolve":
            result = resolution.resolve(records)
        elif a.command == "drift":
            result = drift.run_monitors(records, drift.simulate_designation_round(records, a.simulate) if a.simulate else records)
        else:
            _, nodes, edges = graph_of(records, statements)
            result = edges if a.command == "graph" else ownership.assess(ownership.features(nodes, edges, control_roots(edges))).orderBy(F.desc("score"), "entity_id")
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    else:
        result.show(20, truncate=False)


if __name__ == "__main__":
    main()
