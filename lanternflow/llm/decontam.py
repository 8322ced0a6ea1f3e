"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark form a set of hashes. It is broadcast behind a check of its size (a larger set is joined by
shuffle). Each document is read once: its words are hashed, the hashes are doubled into window hashes (1, 2, 4, 8 words)
and looked up, and each hit is verified by comparing the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_CHARS, BROADCAST_ROWS, fits_broadcast, put_back, result_copies, saved, set_aside, words

WINDOW = 8
MIN_ITEMS = 2


def _with_window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns h1 (hashes of the words w) and h<n> for each length n: the hashes of each run of n words, in order.

    Each level is a column of its own, used more than once by the next, so the optimizer keeps it computed once."""
    df, made = df.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x))), {1}
    for length in lengths:
        covered = 1
        while covered < length:
            step = min(covered, length - covered)
            if covered + step not in made:
                df = df.withColumn("__n", F.greatest(F.size(f"h{covered}") - step, F.lit(0)))
                df = df.withColumn(f"h{covered + step}", F.zip_with(F.slice(f"h{covered}", F.lit(1), F.col("__n")), F.slice(f"h{covered}", F.lit(step + 1), F.col("__n")), lambda a, b: F.xxhash64(a, b))).drop("__n")
                made.add(covered + step)
            covered += step
    return df


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns len, hash, window (text), items (array of item_id): a row for each distinct window.

    An item of fewer words than the window, but not none, is one window. A null text has no words."""
    items = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("len"))
    each = items.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("g"))
    return each.groupBy("len", F.array_join("g", " ").alias("window")).agg(F.collect_set("item_id").alias("items"))


def _hashed(windows: DataFrame, lengths: list[int]) -> DataFrame:
    hashed = F.lit(None).cast("bigint")
    for n in lengths:
        hashed = F.when(F.col("len") == n, F.element_at(f"h{n}", 1)).otherwise(hashed)
    return _with_window_hashes(windows.withColumn("w", F.split("window", " ")), lengths).withColumn("hash", hashed)


def _matches(docs: DataFrame, lengths: list[int], table: DataFrame, key: list[str], few: bool) -> DataFrame:
    """A row for each row of docs with first set, and a row for each verified hit with its span and items.

    With few windows their table is broadcast and all comes from one pass over the texts. Else only positions and hashes
    are shuffled to the windows, and the words of a document meet its candidate hits in a second join, so that no words
    are repeated for each position."""
    no_span, no_items = F.lit(None).cast("struct<pos:int,end:int>"), F.lit(None).cast(table.schema["b_items"].dataType)
    begin, before = F.lit(None).cast("int"), F.lit(1)
    for n in lengths:
        begin, before = F.when(F.col("b_len") == n, F.col("at") - before).otherwise(begin), before + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    inside = F.col("pos").between(0, F.col("n_words") - F.col("b_len"))
    same = F.array_join(F.slice("w", F.col("pos") + 1, F.col("b_len")), " ") == F.col("b_window")
    span = F.struct("pos", (F.col("pos") + F.col("b_len")).alias("end"))
    all_hashes = F.concat(F.array(F.lit(0).cast("bigint")), *[F.col(f"h{n}") for n in lengths])
    if few:
        # each document also looks up a mark, which finds this row: so it stays in an inner join, once
        table = F.broadcast(table.unionByName(docs.sparkSession.createDataFrame([(0, 0, "", [])], table.schema)))
        each = docs.select(*key, "w", "n_words", F.posexplode_outer(all_hashes).alias("at", "hash"))  # outer: no filter that computes it again
        found = each.join(table, F.col("hash") == F.col("b_hash")).withColumn("pos", begin)
        first = (F.col("at") == 0) & (F.col("b_len") == 0)
        found = found.withColumn("hit", F.when(F.col("b_len") > 0, inside & same).otherwise(False)).where(first | F.col("hit"))
        return found.select(*key, "n_words", first.alias("first"), F.when(F.col("hit"), span).alias("span"), F.when(F.col("hit"), F.col("b_items")).alias("items"))
    firsts = docs.select(*key, "n_words", F.lit(True).alias("first"), no_span.alias("span"), no_items.alias("items"))
    each = docs.select(*key, "n_words", F.posexplode_outer(all_hashes).alias("at", "hash")).where("at > 0")
    maybe = each.join(table, F.col("hash") == F.col("b_hash")).withColumn("pos", begin).where(inside).drop("hash", "b_hash", "at")
    texts = docs.select(*[F.col(c).alias("__" + c) for c in key], "w").dropDuplicates(["__" + c for c in key])
    hits = maybe.join(texts, [F.col(c).eqNullSafe(F.col("__" + c)) for c in key]).where(same)
    return firsts.unionByName(hits.select(*key, "n_words", F.lit(False).alias("first"), span.alias("span"), F.col("b_items").alias("items")))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each document doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (array of first and past-last
    word of each covered stretch), contaminated, and text_hash, which with doc_id names the row.

    Null, empty and very long texts are documents like others; null item_ids count as no id. Repeated rows each have
    a result row. An empty benchmark hits nothing. Up to broadcast_rows distinct windows are broadcast."""
    windows = saved(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most as many as the window has words
    table = _hashed(windows, lengths).select(F.col("hash").alias("b_hash"), F.col("len").alias("b_len"), F.col("window").alias("b_window"), F.col("items").alias("b_items"))
    key = ["doc_id", "text_hash", "text_length"]
    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("text_length"), words(F.col("text")).alias("w"))
    docs = _with_window_hashes(docs, lengths).withColumn("n_words", F.size("w"))
    found = _matches(docs, lengths, table, key, fits_broadcast(windows, broadcast_rows, BROADCAST_CHARS))
    per = found.groupBy(*key).agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.sum(F.col("first").cast("int")).alias("__copies"), F.array_sort(F.collect_set("span")).alias("runs"), F.collect_set("items").alias("items")
    )
    merged = F.expr(
        "aggregate(runs, named_struct('done', cast(array() as array<struct<first:int,last:int>>), 'first', -1, 'last', -1),"
        " (a, x) -> if(x.pos <= a.last and a.last >= 0, named_struct('done', a.done, 'first', a.first, 'last', greatest(a.last, x.end)),"
        " named_struct('done', if(a.last < 0, a.done, concat(a.done, array(named_struct('first', a.first, 'last', a.last)))), 'first', x.pos, 'last', x.end)),"
        " a -> if(a.last < 0, a.done, concat(a.done, array(named_struct('first', a.first, 'last', a.last)))))"
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    per = per.withColumn("spans", merged).withColumn("item_ids", ids)
    return result_copies(
        per.select(
            *key, "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.last - x.first)").alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids", "spans",
            (F.size("item_ids") >= min_items).alias("contaminated"), "__copies",
        ),
        "__copies",
    )


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words of the spans (word numbers), and without the separators that follow those words."""
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(f"{word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    head = F.regexp_extract(text, "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (i >= s["first"]) & (i < s["last"])))
    return F.concat(head, F.array_join(kept, ""))


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """documents without the contaminated ones, and without the hit spans in the rest. Its columns stay; n_chars, if it
    is there, follows the text. Rows without a hit are not moved: the few rows with hits are broadcast if their number
    has been checked, else joined by shuffle."""
    hits = contamination(documents, benchmark, window, min_items).where("n_items > 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"), F.col("contaminated").alias("__out")).distinct()
    hits = saved(hits, "hits")
    side = F.broadcast(hits) if fits_broadcast(hits, 20_000, BROADCAST_CHARS) else hits.hint("shuffle_hash")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    docs = set_aside(documents, "doc_id", "text", "n_chars")
    joined = docs.join(side, on, "left").where(~F.coalesce("__out", F.lit(False)))
    text = F.when(F.col("__spans").isNotNull(), without_spans(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return put_back(joined, docs, documents)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    d = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
with b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 8) n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) i from b where len(w) > 0)),
d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') g from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
h as (select r, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
c as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from h) group by r),
m as (select r, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join c using (r) left join m using (r)
"""
