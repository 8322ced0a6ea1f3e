"""Review memos for all subjects at once, as a column of text with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ownership import paths


def chain_view(nodes: DataFrame, e: DataFrame, targets: DataFrame, max_depth: int = 12) -> DataFrame:
    """root, step, parent, parent_name, child, child_name, child_jurisdiction, interest_type, share_percent, confidence,
    statements: the deepest control chain of each target, first in the order of the walk among equals."""
    deepest = paths(e, targets, max_depth).groupBy("root").agg(F.min_by("trail", F.struct(-F.col("depth"), "trail")).alias("trail"))
    steps = deepest.select("root", F.posexplode("trail").alias("step", "edge_seq")).join(e.withColumn("edge_seq", F.col("edge_seq").cast("bigint")), "edge_seq")
    name = lambda side: nodes.select(F.col("entity_id").alias(side), F.col("canonical_name").alias(f"{side}_name"), F.col("jurisdiction").alias(f"{side}_jurisdiction"))
    j = steps.join(name("parent"), "parent", "left").join(name("child"), "child", "left")
    return j.select("root", "step", "parent", F.coalesce("parent_name", F.col("parent").cast("string")).alias("parent_name"), "child", F.coalesce("child_name", F.col("child").cast("string")).alias("child_name"), "child_jurisdiction", "interest_type", "share_percent", "confidence", "statements")


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def memos(entities: DataFrame, assessed: DataFrame, chains: DataFrame, guidance: DataFrame) -> DataFrame:
    """memo_id, text: entities with an assessment. guidance: entity_id, section_id, title (ranked), cited as [reg:...];
    statements are cited as [stmt:...]."""
    said = lambda s: F.concat(F.lit("- "), s["parent_name"], F.lit(" holds "), F.when(s["share_percent"] > 0, F.format_string("%.0f%%", s["share_percent"])).otherwise("an unstated share"), F.lit(" of "), s["child_name"], F.lit(" ("), s["interest_type"], F.lit(") [stmt:"), F.coalesce(F.try_element_at(s["statements"], F.lit(1)), F.lit("unknown")), F.lit("]"))
    c = chains.groupBy(F.col("root").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct("step", "parent_name", "child_name", "interest_type", "share_percent", "statements"))).alias("chain"))
    g = guidance.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section_id", "title"))).alias("guidance"))
    j = entities.join(assessed, "entity_id").join(c, "entity_id", "left").join(g, "entity_id", "left")
    head = F.concat(F.lit("# Ownership review: "), "canonical_name", F.lit("\n\nEntity "), "entity_id", F.lit(" ("), "entity_type", F.lit("), jurisdictions "), F.array_join("jurisdictions", ", "))
    identity = F.concat(F.lit("## Identity\n\n"), _lines(F.col("provenance"), lambda p: F.concat(F.lit("- "), p["record_id"], F.lit(" ("), p["source"], F.lit("): "), p["name_as_recorded"])))
    control = F.concat(F.lit("## Ownership\n\n"), F.coalesce(_lines(F.col("chain"), said), F.lit("No control chain is on record.")))
    risk = F.concat(F.lit("## Structure\n\nScore "), F.format_string("%.2f", "score"), F.when(F.col("flagged"), ", referred for review.").otherwise(", below the threshold."), F.when(F.size("reasons") > 0, F.concat(F.lit("\n\n"), _lines(F.col("reasons"), lambda r: F.concat(F.lit("- "), r)))).otherwise(""))
    rules = F.concat(F.lit("## Guidance\n\n"), F.coalesce(_lines(F.col("guidance"), lambda s: F.concat(F.lit("- "), s["title"], F.lit(" [reg:"), s["section_id"], F.lit("]"))), F.lit("None retrieved.")))
    return j.select(F.col("entity_id").alias("memo_id"), F.concat_ws("\n\n", head, identity, control, risk, rules).alias("text"))
