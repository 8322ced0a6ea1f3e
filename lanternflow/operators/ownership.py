"""The control graph: edges from statements, paths, cycles, effective holdings, structural features, risk scores.

Edges: parent, child, interest_type, share_percent, confidence, n_statements, edge_seq. Paths grow by one join per level,
each level a table, so a plan never holds more than one join; depth is bounded by the caller, as paths can be many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolution import written

# Control kinds, secrecy jurisdictions, nominee markers, weights, thresholds.
CONTROL_KINDS = ["shareholding", "ownership", "consolidation"]
SECRECY = "KY VG PA SC BZ AE CY MT BS BM JE GG IM LI".split()
NOMINEE = "nominee|trust|fiduciar|secretaria|corporate services|management services"
RULE_WEIGHTS = {
    "chain_depth": 0.10, "controlled_count": 0.02, "jurisdiction_hops": 0.09, "secrecy_hops": 0.16, "secrecy_ratio": 0.40, "in_cycle": 0.30, "max_intermediary_centrality": 0.60,
    "shared_intermediaries": 0.03, "nominee_intermediaries": 0.30, "secrecy_co_owners": 0.45, "mean_edge_confidence": -0.10, "ownership_attenuation": 0.004, "sub_threshold_holdings": 0.10, "single_source_edges": 0.05,
}
CONTROL_THRESHOLD, MAX_DEPTH, CENTRALITY_DEPTH, PATH_LIMIT, CYCLE_LENGTH, RISK_THRESHOLD = 25.0, 12, 8, 200, 8, 1.0


def lifted(statements: DataFrame, bridge: DataFrame) -> DataFrame:
    """statements with parent and child entities, or null, and a reason for those that make no edge.

    bridge: record_id, entity_id."""
    p, c = bridge.select(F.col("record_id").alias("interested_record_id"), F.col("entity_id").alias("parent")), bridge.select(F.col("record_id").alias("subject_record_id"), F.col("entity_id").alias("child"))
    j = statements.join(p, "interested_record_id", "left").join(c, "subject_record_id", "left")
    reason = F.when(F.col("parent").isNull(), "interested party not resolved").when(F.col("child").isNull(), "subject not resolved").when(F.col("parent") == F.col("child"), "both ends are one entity")
    return j.withColumn("reason", reason)


def edges(statements: DataFrame, entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Statements of one parent, child and kind merge: the best confidence (statement times the weaker end's weakest
    link), the largest share, all statements in order."""
    weak = entities.select("entity_id", "weakest_link")
    s = lifted(statements, bridge).where(F.col("reason").isNull())
    s = s.join(weak.select(F.col("entity_id").alias("parent"), F.col("weakest_link").alias("wp")), "parent").join(weak.select(F.col("entity_id").alias("child"), F.col("weakest_link").alias("wc")), "child")
    return merged(s.withColumn("confidence", F.col("confidence") * F.least("wp", "wc")))


def merged(s: DataFrame) -> DataFrame:
    """parent, child, interest_type, share_percent, confidence, statement_id, stmt_seq -> edges."""
    return s.groupBy("parent", "child", "interest_type").agg(
        F.max("share_percent").alias("share_percent"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_statements"), F.transform(F.array_sort(F.collect_list(F.struct("stmt_seq", "statement_id"))), lambda x: x["statement_id"]).alias("statements"), F.min("stmt_seq").alias("edge_seq")
    )


def control(e: DataFrame) -> DataFrame:
    return e.where(F.col("interest_type").isin(CONTROL_KINDS))


def roots(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes (entity_id) that no edge of any kind goes into."""
    return nodes.select("entity_id").join(e.select(F.col("child").alias("entity_id")).distinct(), "entity_id", "left_anti")


def descendants(e: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """root, node, depth: the least number of edges from each start (root) over edges of all kinds; the start itself is out."""
    hops = e.select("parent", "child").distinct()
    seen = written(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(hops, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        front = written(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = written(seen.unionByName(front))
    return seen.where("depth > 0")


def paths(e: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, limit: int | None = PATH_LIMIT) -> DataFrame:
    """root, node (the end), nodes, trail (edge_seq of each edge), depth, product (of shares), confidences: the simple
    paths over control edges from each start, every beginning of a path included. limit: so many per root, in the order
    of a depth-first walk, which is the order of the trails; each level keeps no more, so a dense graph ends too."""
    hop = control(e).select("parent", "child", "edge_seq", "share_percent", "confidence", "n_statements")
    none = lambda t: F.array().cast(f"array<{t}>")
    front = starts.select("root", F.col("root").alias("node"), F.array("root").alias("nodes"), none("bigint").alias("trail"), F.lit(1.0).alias("product"), none("double").alias("confidences"), none("bigint").alias("counts"))
    found = None
    for level in range(1, max_depth + 1):
        j = front.join(hop, F.col("node") == F.col("parent")).where(~F.array_contains("nodes", F.col("child")))
        step = j.select(
            "root", F.col("child").alias("node"), F.concat("nodes", F.array("child")).alias("nodes"),
            F.concat("trail", F.array(F.col("edge_seq").cast("bigint"))).alias("trail"), (F.col("product") * F.col("share_percent") / 100).alias("product"),
            F.concat("confidences", F.array("confidence")).alias("confidences"), F.concat("counts", F.array("n_statements")).alias("counts"), F.lit(level).alias("depth"),
        )
        if limit is None:
            front = written(step)
            found = front if found is None else found.unionByName(front)
        else:
            # a path past the limit among those found so far never comes back, nor do its extensions, which follow it
            every = step if found is None else found.unionByName(step)
            first = F.row_number().over(Window.partitionBy("root").orderBy("trail"))
            found = written(every.withColumn("__n", first).where(F.col("__n") <= limit).drop("__n"))
            front = found.where(F.col("depth") == level)
        if not front.limit(1).count():
            break
        front = front.drop("depth")
    return found


def cycles(e: DataFrame, max_length: int = CYCLE_LENGTH) -> DataFrame:
    """nodes (sorted), length: circles of control edges of at least two nodes, one for each set of nodes.

    Each is walked from its least node only, over nodes that are larger."""
    hop = control(e).select("parent", "child").distinct()
    front = hop.where("parent < child").select(F.col("parent").alias("start"), F.col("child").alias("node"), F.array("parent", "child").alias("nodes"))
    found = None
    for _ in range(2, max_length + 1):
        front = written(front)
        if not front.limit(1).count():
            break
        closed = front.join(hop, (F.col("node") == F.col("parent")) & (F.col("start") == F.col("child"))).select(F.array_sort("nodes").alias("nodes"))
        found = closed if found is None else found.unionByName(closed)
        front = front.join(hop, F.col("node") == F.col("parent")).where((F.col("child") > F.col("start")) & ~F.array_contains("nodes", F.col("child"))).select("start", F.col("child").alias("node"), F.concat("nodes", F.array("child")).alias("nodes"))
    if found is None:
        found = front.select("nodes").limit(0)
    return found.distinct().withColumn("length", F.size("nodes"))


def effective_shares(p: DataFrame) -> DataFrame:
    """root, child, effective: the largest product of shares over the paths between them, in percent; none of zero."""
    return p.groupBy("root", F.col("node").alias("child")).agg((F.max("product") * 100).alias("effective")).where("effective > 0")


def betweenness(p: DataFrame) -> DataFrame:
    """node, centrality: the share of paths that a node is inside of; roots_served: of how many roots."""
    total = p.agg(F.count(F.lit(1)).alias("total"))
    inside = p.select("root", F.explode(F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 2, F.lit(0)))).alias("node"))
    per = inside.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("roots_served"))
    return per.join(F.broadcast(total)).select("node", (F.col("n") / F.col("total")).alias("centrality"), "roots_served")  # total is one row


def features(nodes: DataFrame, e: DataFrame, targets: DataFrame) -> DataFrame:
    """The fourteen structural features of each target (root). nodes: entity_id, canonical_name, jurisdiction."""
    every = roots(nodes, e).select(F.col("entity_id").alias("root"))
    central = betweenness(written(paths(e, every, CENTRALITY_DEPTH))).select("node", "centrality")
    served = betweenness(written(paths(e, every, MAX_DEPTH))).select("node", "roots_served")
    mine = written(paths(e, targets, MAX_DEPTH))
    below = descendants(e, targets).groupBy("root").agg(F.count(F.lit(1)).cast("double").alias("controlled_count"))
    deepest = mine.groupBy("root").agg(F.max("depth").cast("double").alias("chain_depth"), F.min_by("nodes", F.struct(-F.col("depth"), "trail")).alias("chain"))
    secret = F.col("jurisdiction").isin(SECRECY)
    in_circle = cycles(e).select(F.explode("nodes").alias("node")).distinct().withColumn("circle", F.lit(1.0))
    at = deepest.select("root", "chain", F.posexplode("chain").alias("pos", "node"))
    at = at.join(nodes.select(F.col("entity_id").alias("node"), F.lower("canonical_name").alias("name"), "jurisdiction"), "node", "left").join(central, "node", "left").join(served, "node", "left").join(in_circle, "node", "left")
    at = at.withColumn("mid", (F.col("pos") > 0) & (F.col("pos") < F.size("chain") - 1)).withColumn("before", F.lag("jurisdiction").over(Window.partitionBy("root").orderBy("pos")))
    shared = F.col("mid") & (F.coalesce("roots_served", F.lit(0)) > 1)
    per_chain = at.groupBy("root").agg(
        F.count_if((F.col("before") != "") & (F.col("jurisdiction") != "") & (F.col("before") != F.col("jurisdiction"))).cast("double").alias("jurisdiction_hops"), F.count_if(secret).cast("double").alias("secrecy_hops"),
        (F.count_if(secret) / F.count(F.lit(1))).alias("secrecy_ratio"), F.coalesce(F.max("circle"), F.lit(0.0)).alias("in_cycle"), F.coalesce(F.max(F.when(F.col("mid"), F.col("centrality"))), F.lit(0.0)).alias("max_intermediary_centrality"),
        F.count_if(shared).cast("double").alias("shared_intermediaries"), F.count_if(shared & (F.col("name").rlike(NOMINEE) | secret)).cast("double").alias("nominee_intermediaries"),
    )
    owners = at.where("pos > 0").select("root", "chain", "node").join(control(e).select(F.col("child").alias("node"), F.col("parent").alias("owner")), "node").where(~F.array_contains("chain", F.col("owner")))
    owners = owners.join(nodes.where(secret).select(F.col("entity_id").alias("owner")), "owner").groupBy("root").agg(F.countDistinct("owner").cast("double").alias("secrecy_co_owners"))
    each = mine.select("root", F.explode(F.arrays_zip("confidences", "counts")).alias("x")).groupBy("root").agg(F.avg("x.confidences").alias("mean_edge_confidence"), F.avg((F.col("x.counts") == 1).cast("double")).alias("single_source_edges"))
    held = effective_shares(mine).groupBy("root").agg(F.min("effective").alias("least"), F.count_if(F.col("effective") < CONTROL_THRESHOLD).cast("double").alias("sub_threshold_holdings"))
    direct = control(e).groupBy(F.col("parent").alias("root")).agg(F.max("share_percent").alias("direct"))
    out = targets.select("root")
    for part in (deepest.drop("chain"), below, per_chain, owners, each, held, direct):
        out = out.join(part, "root", "left")
    out = out.withColumn("ownership_attenuation", F.when(F.col("least").isNotNull(), F.greatest(F.coalesce("direct", F.lit(0.0)) - F.col("least"), F.lit(0.0))).otherwise(0.0))
    has = F.col("chain_depth").isNotNull()
    blank = {"mean_edge_confidence": 1.0}
    return out.select(F.col("root").alias("entity_id"), *[F.when(has, F.coalesce(F.col(c), F.lit(0.0))).otherwise(blank.get(c, 0.0)).alias(c) for c in RULE_WEIGHTS])


def assess(found: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """entity_id, score, flagged, contributions (map) and reasons."""
    score = sum((F.col(k) * w for k, w in RULE_WEIGHTS.items()), F.lit(0.0))
    parts = F.create_map(*[x for k, w in RULE_WEIGHTS.items() for x in (F.lit(k), F.col(k) * w)])
    return found.withColumn("score", score).select("entity_id", "score", (F.col("score") >= threshold).alias("flagged"), parts.alias("contributions"), describe().alias("reasons"))


def top_contributions(assessed: DataFrame, n: int = 5) -> DataFrame:
    x = F.transform(F.map_entries("contributions"), lambda e: F.struct((-F.abs(e["value"])).alias("order"), e["key"].alias("feature"), e["value"].alias("value")))
    return assessed.select("entity_id", F.explode(F.slice(F.array_sort(x), 1, n)).alias("x")).select("entity_id", "x.feature", "x.value")


def describe() -> Column:
    """Sentences for the features that fired."""
    n = lambda c: F.col(c).cast("int").cast("string")
    said = [
        (F.col("chain_depth") >= 4, F.concat(F.lit("the chain has "), n("chain_depth"), F.lit(" layers of control"))),
        (F.col("secrecy_hops") >= 2, F.concat(n("secrecy_hops"), F.lit(" entities of the deepest chain are in secrecy jurisdictions"))),
        (F.col("jurisdiction_hops") >= 3, F.concat(F.lit("the chain changes jurisdiction "), n("jurisdiction_hops"), F.lit(" times"))),
        (F.col("in_cycle") > 0, F.lit("ownership runs in a circle")),
        (F.col("nominee_intermediaries") > 0, F.concat(n("nominee_intermediaries"), F.lit(" intermediaries serve several owners and look like nominees"))),
        (F.col("secrecy_co_owners") > 0, F.concat(n("secrecy_co_owners"), F.lit(" owners outside the chain are in secrecy jurisdictions"))),
        (F.col("max_intermediary_centrality") >= 0.1, F.lit("an intermediary is on many unrelated control paths")),
        (F.col("sub_threshold_holdings") > 0, F.concat(n("sub_threshold_holdings"), F.lit(" effective holdings are below the disclosure threshold"))),
        (F.col("mean_edge_confidence") < 0.8, F.concat(F.lit("mean confidence of the chain is "), F.round("mean_edge_confidence", 4).cast("string"))),
    ]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in said]))


def threshold_sweep(assessed: DataFrame, labels: DataFrame, steps: int = 41, width: float = 0.05) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall, f1 of flagging at each threshold. labels: entity_id, label."""
    x = assessed.select("entity_id", "score").join(labels.select("entity_id", "label"), "entity_id")
    x = x.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct((i * width).alias("threshold"), (F.col("score") >= i * width).alias("hit")))).alias("t")).select("label", "t.*")
    c = x.groupBy("threshold").agg(*[F.count_if((F.col("hit") == h) & (F.col("label") == y)).alias(k) for k, h, y in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    return prf(c)


def prf(c: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
