"""More demonstration queries, each with SQL for the same rows: blocking families, capped paths and chains, graph statistics,
weights, truth, gates, citations, language, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.operators import evaluation, language_gate, memo, ownership, resolution, retrieval, screening

from . import demo
from .demo import query, table

# ---- blocking -----------------------------------------------------------------------------------------------------

_KEYS_SQL = demo._SCORES_SQL + """, tk as (select r, unnest(addr) token from n2), td as (select token, count(*) df from tk group by token),
ra as (select r, token, row_number() over (partition by r order by df, token) k from tk join td using (token) where len(token) > 3 and df <= 8),
ss as (select r, list_sort(list_distinct(sig)) s, sound, replace(nm, ' ', '') flat, ident from n2),
kk2 as (
  select r, 'name_tokens' key_type, unnest(case when len(s) <= 1 then s else flatten(list_transform(s, lambda x: list_transform(list_filter(s, lambda y: y > x), lambda z: x || '+' || z))) end) v from ss
  union all select r, 'prefix', substr(flat, 1, 6) from ss where flat <> '' union all select r, 'phonetic', sound from ss where sound <> ''
  union all select r, 'address', token from ra where k <= 2 union all select r, 'identifier', ident from ss where ident <> ''),
keys as (select distinct r record_id, key_type, 'c|' || v "key" from kk2)
"""


@query(_KEYS_SQL + "select record_id, key_type, \"key\" from keys")
def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.blocking_keys(demo._part_records(spark, sf_dir))


@query(_KEYS_SQL + """, bl as (select key_type, "key", count(*) n from keys group by all)
select key_type, count(*) blocks, count(*) filter (where n > 60) dropped_blocks, coalesce(sum(n * (n - 1) / 2) filter (where n > 60), 0)::bigint dropped_pairs, coalesce(sum(n * (n - 1) / 2) filter (where n <= 60), 0)::bigint kept_pairs from bl group by key_type""")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.block_counts(resolution.blocking_keys(demo._part_records(spark, sf_dir)))


@query(demo._TOKENS_SQL + """, t as (select a, b, unnest(list_intersect(aw, bw)) token, a_type = b_type same from j),
m as (select token from t group by token having count(*) filter (where same) > 0 and count(*) filter (where same) >= 0.8 * count(*))
select distinct a, b from t join m using (token)""")
def memoriser_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = demo._named(spark, sf_dir, demo._part_pairs(spark, sf_dir)).withColumn("label", F.col("a_type") == F.col("b_type"))
    j = resolution.written(j)
    return evaluation.memoriser_predict(j, evaluation.memorised_tokens(j))


# ---- control graph ------------------------------------------------------------------------------------------------

_TRAILS_SQL = demo._TRADE_SQL + """b(root, node, nodes, trail) as (select n_nationkey::bigint, n_nationkey::bigint, [n_nationkey::bigint], []::bigint[] from nation
  union all select root, c, list_append(nodes, c), list_append(trail, seq::bigint) from b join e on node = p where len(trail) < 12 and not list_contains(nodes, c))
"""


@query(_TRAILS_SQL + "select root, path, rank from (select root, array_to_string(nodes, '>') path, row_number() over (partition by root order by trail) rank from b where len(trail) > 0) where rank <= 5")
def capped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ownership.paths(demo._trade(spark, sf_dir), demo._nations(spark, sf_dir), ownership.MAX_DEPTH, 5)
    rank = F.row_number().over(demo.Window.partitionBy("root").orderBy("trail")).cast("bigint")
    return p.select("root", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), rank.alias("rank"))


def _trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("entity_id"), F.col("n_name").alias("canonical_name"), F.upper(F.substring("n_name", 1, 2)).alias("jurisdiction"))


@query(_TRAILS_SQL + """, capped as (select * from (select *, row_number() over (partition by root order by trail) k from b where len(trail) > 0) where k <= 200),
top as (select * from (select *, row_number() over (partition by root order by len(trail) desc, trail) t from capped) where t = 1),
s as (select root, unnest(range(1, len(nodes))) i, nodes from top)
select root, i - 1 step, x.n_name parent_name, y.n_name child_name from s join nation x on nodes[i] = x.n_nationkey join nation y on nodes[i + 1] = y.n_nationkey""")
def trade_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo._trade(spark, sf_dir).withColumn("statements", F.array().cast("array<string>"))
    chain = memo.chain_view(_trade_nodes(spark, sf_dir), e, demo._nations(spark, sf_dir))
    return chain.select("root", F.col("step").cast("bigint").alias("step"), "parent_name", "child_name")


@query(demo._TRADE_SQL + f"""b(start, node, nodes) as (select p, c, [p, c] from e where p < c union all select start, c, list_append(nodes, c) from b join e on node = p where c > start and not list_contains(nodes, c) and len(nodes) < 8),
cy as (select distinct list_sort(nodes) s from b join e on b.node = e.p and b.start = e.c)
select (select count(*) from nation) nodes, (select count(*) from e) edges, (select count(*) from e) control_edges, (select count(*) from nation where n_nationkey not in (select c from e)) roots,
  (select count(*) from cy) cycles, (select count(*) from nation where upper(substr(n_name, 1, 2)) in ({", ".join(f"'{x}'" for x in sorted(ownership.SECRECY))})) secrecy_nodes""")
def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = screening.graph_stats(_trade_nodes(spark, sf_dir), demo._trade(spark, sf_dir))
    return s.select("nodes", "edges", "control_edges", "roots", "cycles", "secrecy_nodes")


_IN_SECRECY = "in (" + ", ".join(f"'{x}'" for x in sorted(ownership.SECRECY)) + ")"
#: The fourteen features and the score, from paths enumerated by SQL.
demo.SQL["trade_risk"] = demo._TRADE_SQL + f"""b(root, node, nodes, trail, prod) as (select n_nationkey::bigint, n_nationkey::bigint, [n_nationkey::bigint], []::bigint[], 1.0::double from nation
  union all select root, c, list_append(nodes, c), list_append(trail, seq::bigint), prod * share / 100 from b join e on node = p where len(trail) < 12 and not list_contains(nodes, c)),
nn as (select n_nationkey::bigint id, lower(n_name) nm, upper(substr(n_name, 1, 2)) j from nation),
mine as (select * from (select *, row_number() over (partition by root order by trail) k from b where len(trail) > 0) where k <= 200),
tops as (select id from nn where id not in (select c from e)),
short as (select * from (select *, row_number() over (partition by root order by trail) k from b where len(trail) between 1 and 8 and root in (select id from tops)) where k <= 200),
central as (select node, count(*) / (select count(*) from short) cen from (select unnest(nodes[2:len(nodes) - 1]) node from short) group by node),
served as (select node, count(distinct root) n from (select root, unnest(nodes[2:len(nodes) - 1]) node from mine where root in (select id from tops)) group by node),
w(start, node, nodes) as (select p, c, [p, c] from e where p < c union all select start, c, list_append(nodes, c) from w join e on node = p where c > start and not list_contains(nodes, c) and len(nodes) < 8),
circle as (select distinct unnest(nodes) node from w join e on w.node = e.p and w.start = e.c),
g(root, node, depth) as (select id, id, 0 from nn union select root, c, depth + 1 from g join e on node = p where depth < 12),
below as (select root, count(distinct node) controlled_count from g where node <> root group by root),
deep as (select root, len(trail) chain_depth, nodes chain from (select *, row_number() over (partition by root order by len(trail) desc, trail) t from mine) where t = 1),
at0 as (select root, chain, unnest(range(1, len(chain) + 1)) i from deep),
at1 as (select root, chain, i, chain[i] node, nn.nm, nn.j, i > 1 and i < len(chain) mid, coalesce(cen, 0) cen, coalesce(served.n, 0) srv, circle.node is not null cyc, lag(nn.j) over (partition by root order by i) bj
  from at0 join nn on chain[i] = nn.id left join central on central.node = nn.id left join served on served.node = nn.id left join circle on circle.node = nn.id),
per as (select root, count(*) filter (where bj <> '' and j <> '' and bj <> j) jurisdiction_hops, count(*) filter (where j {_IN_SECRECY}) secrecy_hops, count(*) filter (where j {_IN_SECRECY}) / count(*) secrecy_ratio, max(cyc::int) in_cycle,
  coalesce(max(cen) filter (where mid), 0) max_intermediary_centrality, count(*) filter (where mid and srv > 1) shared_intermediaries, count(*) filter (where mid and srv > 1 and (regexp_matches(nm, '{ownership.NOMINEE}') or j {_IN_SECRECY})) nominee_intermediaries from at1 group by root),
own as (select root, count(distinct e.p) secrecy_co_owners from at1 join e on e.c = at1.node join nn on nn.id = e.p where i > 1 and not list_contains(chain, e.p) and nn.j {_IN_SECRECY} group by root),
eff as (select root, node, 100 * max(prod) x from mine group by all having max(prod) > 0), held as (select root, min(x) lo, count(*) filter (where x < 25) sub_threshold_holdings from eff group by root),
dir as (select p root, max(share) d from e group by p),
f as (select nn.id, chain_depth is not null has, coalesce(chain_depth, 0) chain_depth, coalesce(controlled_count, 0) controlled_count, per.*, coalesce(secrecy_co_owners, 0) secrecy_co_owners, 1.0 mean_edge_confidence, 1.0 single_source_edges,
  coalesce(sub_threshold_holdings, 0) sub_threshold_holdings, case when lo is not null then greatest(coalesce(d, 0) - lo, 0) else 0 end ownership_attenuation
  from nn left join deep on deep.root = nn.id left join below on below.root = nn.id left join per on per.root = nn.id left join own on own.root = nn.id left join held on held.root = nn.id left join dir on dir.root = nn.id),
sc as (select *, case when has then {" + ".join(f"{w} * coalesce({k}, 0)" for k, w in ownership.RULE_WEIGHTS.items())} else {ownership.RULE_WEIGHTS["mean_edge_confidence"]} end score from f)
select id entity_id, round(score, 6) score, score >= 1 flagged, (has and chain_depth >= 4)::int + (has and secrecy_hops >= 2)::int + (has and jurisdiction_hops >= 3)::int + (has and in_cycle > 0)::int + (has and nominee_intermediaries > 0)::int + (has and secrecy_co_owners > 0)::int
  + (has and max_intermediary_centrality >= 0.1)::int + (has and sub_threshold_holdings > 0)::int n_reasons from sc"""


# ---- weights, truth, gates ----------------------------------------------------------------------------------------

_TRIALS = ", ".join(f"({', '.join(map(repr, t))})" for t in evaluation.trial_weights(400, 11))
_W = list(evaluation.WEIGHTS)
demo.SQL["weight_fit"] = demo._TRUTH_SQL + f""", w as (select * from (values {_TRIALS}) v(trial, {", ".join("w_" + k for k in _W)})),
lb as (select sc.*, t.a is not null yes from sc left join t on sc.a = t.a and sc.b = t.b),
r0 as (select trial, yes, identifier_match im, birth_date_match bm, {" + ".join(f"{k} * w_{k}" for k in _W)} s from lb, w),
r1 as (select trial, yes, bm, case when im = 1 then greatest(s, 0.95) else s end s from r0), r2 as (select trial, yes, case when bm < 0 then least(s, 0.2) else s end s from r1),
c as (select trial, h threshold, count(*) filter (where s >= h and yes) tp, count(*) filter (where s >= h and not yes) fp, count(*) filter (where s < h and yes) fn from r2, (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85]::double[]) h) group by all),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end "precision", case when tp + fn > 0 then tp / (tp + fn) else 0 end recall from c),
z as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0 end f1 from m)
select trial, threshold, tp, fp, fn, "precision", recall, f1 from z order by round(f1, 4) desc, trial, threshold limit 1"""


@query(demo._ENTITIES_SQL + """, v as (select 'E-' || c entity_id, p_name seed, count(*) votes from co join part on n = p_partkey group by all),
w as (select *, row_number() over (partition by entity_id order by votes desc, seed) k, sum(votes) over (partition by entity_id) al, count(*) over (partition by entity_id) seeds from v)
select entity_id, seed, votes, seeds, round(votes / al, 9) purity from w where k = 1""")
def majority_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("seed"))
    m = evaluation.majority_seed(demo._entities(spark, sf_dir, resolution.REVIEW_CAP), truth)
    return m.withColumn("purity", F.round("purity", 9))


@query("""
with v as (select p_brand e, p_name s, count(*) n from part group by all), w as (select *, row_number() over (partition by e order by n desc, s) k, count(*) over (partition by e) seeds from v), m as (select * from w where k = 1), f as (select s, count(*) parts, count(*) filter (where seeds > 1) impure from m group by s)
select sum(parts)::bigint resolved_entities_mapped, sum(impure)::bigint false_merges, count(*) filter (where parts > 1) fragmented_seed_entities, max(parts) worst_fragmentation from f""")
def mapping_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    groups = p.groupBy(F.col("p_brand").alias("entity_id")).agg(F.collect_list("p_partkey").alias("record_ids"))
    return evaluation.mapping_quality(evaluation.majority_seed(groups, p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("seed"))))


@query("""
with x as (select doc_id, n_chars >= 2000 hit, quality = 1 yes from documents join labels using (doc_id)),
c as (select count(*) filter (where hit and yes) tp, count(*) filter (where hit and not yes) fp, count(*) filter (where not hit and yes) fn, count(*) filter (where not hit and not yes) tn,
  md5(array_to_string(list_sort(list(doc_id) filter (where hit)), ',')) flagged, md5(array_to_string(list_sort(list(doc_id) filter (where not hit and yes)), ',')) missed from x)
select tp, fp, fn, tn, flagged, missed, round(tp / (tp + fp), 9) "precision", round(tp / (tp + fn), 9) recall from c""")
def layering_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), (F.col("n_chars") >= 2000).alias("flagged"))
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id"), (F.col("quality") == 1).alias("label"))
    c = evaluation.layering_confusion(d, y)
    lists = [F.md5(F.array_join(F.transform(x, lambda i: i.cast("string")), ",")).alias(x) for x in ("flagged", "missed")]
    return c.select("tp", "fp", "fn", "tn", *lists, F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""
with m as (select 'er_f1' metric, avg(quality) v from labels union all select 'er_precision', 1 - avg(toxic) from labels union all select 'recall_at_5', 1.0),
g as (select * from (values {", ".join(f"('{k}', {v})" for k, v in evaluation.GATES.items())}) t(metric, least))
select metric, round(v, 9) "value", least::double "least", coalesce(v >= least, false) passed from g left join m using (metric)""")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("er_f1"), (1 - F.avg("toxic")).alias("er_precision"), F.lit(1.0).alias("recall_at_5"))
    metrics = y.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in y.columns])).alias("m")).select("m.*")
    return evaluation.gates(metrics).withColumn("value", F.round("value", 9))


# ---- texts --------------------------------------------------------------------------------------------------------


@query("""
with m as (select doc_id memo, lang in ('en', 'de') a, source like '%1' b from documents)
select memo, 2::bigint cited, (not a)::bigint + (not b)::bigint unresolved, 1 - ((not a)::bigint + (not b)::bigint) / 2 rate from m""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    memos = d.select(F.col("doc_id").alias("memo_id"), F.format_string("As [reg:%s] and [see %s] say [cite:%s].", "lang", "doc_id", "source").alias("text"))
    valid = d.where("source like '%1'").select(F.col("source").alias("id")).unionByName(d.where("lang in ('en', 'de')").select(F.col("lang").alias("id")))
    return language_gate.verify_citations(memos, valid)


def _gate_sql(source: str, key: str) -> str:
    """key and the verdict on each text x of source."""
    quoted = lambda p: p.replace("'", "''")
    hits = [rf"regexp_matches(regexp_replace(s, '\b(not|never|neither|no)\b[^.]{{0,30}}\b{w}\w*\b', ' ', 'g'), '\b{w}\w*\b')::int" for w in language_gate.ADVERSE]
    hits += [f"regexp_matches(s, '{quoted(p)}')::int" for p in language_gate.DISQUALIFYING]
    return rf"""
with t as (select {key}, x, lower(x) low from ({source})),
s as (select {key}, low, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, ' ')), lambda z: regexp_matches(z, '{quoted(language_gate.CONTEXT)}')) ss from t),
u as (select {key}, unnest(list_transform(ss, lambda y: lower(y))) s from s), v as (select {key}, sum({" + ".join(hits)})::bigint n from u group by all),
f as (select {key}, len(ss) > 0 pep_mentioned, coalesce(n, 0) n_violations, len(ss) > 0 and contains(low, 'enhanced due diligence') and (contains(low, 'not an adverse finding') or contains(low, 'not itself an adverse') or contains(low, 'does not')) framing_present from s left join v using ({key}))
select {key}, pep_mentioned, n_violations, framing_present, not pep_mentioned or (n_violations = 0 and framing_present) passed from f"""


demo.SQL["language_gate_check"] = _gate_sql("select doc_id, coalesce(text, '') x from documents", "doc_id")
_TURNS_SQL = """select conv_id, turn, coalesce(text, '') || case turn % 4 when 0 then ' The minister is corrupt. We do not onboard.' when 1 then ' A PEP match needs enhanced due diligence. It is not an adverse finding on the PEP.'
  when 2 then ' The PEP was never guilty of fraud.' else '' end x from conversations"""


@query(_gate_sql(_TURNS_SQL, "conv_id, turn"))
def language_gate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each with a sentence or two added that the gate has to judge."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 4 == 0, " The minister is corrupt. We do not onboard.").when(F.col("turn") % 4 == 1, " A PEP match needs enhanced due diligence. It is not an adverse finding on the PEP.").when(F.col("turn") % 4 == 2, " The PEP was never guilty of fraud.").otherwise("")
    d = language_gate.language_check(c.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), said).alias("text")))
    return d.select("conv_id", "turn", "pep_mentioned", "n_violations", "framing_present", "passed")


@query(demo._BM25_SQL + f""", head as (select * from r where rank <= 20), dd as (select doc_id, list_distinct(w) w from d where doc_id in (select doc_id from head)),
tt as (select doc_id, list_distinct({demo._tokens_sql("substr(text, 1, 80)")}) tt, doc_id % 2 = 0 fatf from documents where doc_id in (select doc_id from head)),
qq as (select item_id, list(distinct term) qt, item_id % 2 = 0 fatf from q group by item_id),
idf as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df, s),
cv as (select item_id, doc_id, sum(idf) al, sum(case when list_contains(dd.w, term) then idf else 0 end) got from head join q using (item_id) join dd using (doc_id) join idf using (term) group by all),
sc as (select h.item_id, h.doc_id, case when h.rank <= 15 then 3.0 / h.rank + 1.4 * (case when coalesce(al, 0) > 0 then got / al else 0 end) + 0.8 * len(list_intersect(qt, tt)) / len(qt) + case when qq.fatf and tt.fatf then 2.2 else 0 end else -h.rank::double end score
  from head h join qq using (item_id) join tt using (doc_id) left join cv on h.item_id = cv.item_id and h.doc_id = cv.doc_id)
select item_id query, doc_id doc, round(score, 6) score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id)::int rank from sc""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    d = t.select(F.col("doc_id").alias("doc"), retrieval.tokenize(F.col("text")).alias("tokens"), retrieval.tokenize(F.substring("text", 1, 80)).alias("title_tokens"), F.when(F.col("doc_id") % 2 == 0, "FATF").alias("regime"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), retrieval.tokenize(F.col("text")).alias("tokens"), F.when(F.col("item_id") % 2 == 0, "FATF").alias("regime"))
    found = retrieval.rerank(resolution.written(demo._bm25(spark, sf_dir, 20)), q, d)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "rank")
