"""Secret scans with DataFrame functions only, judged by corpus-wide ownership.

Matches and what lies between them come from two passes of one expression, so their offsets are running sums of lengths.
Each value found is hashed; over the corpus the hashes are counted by distinct repositories (documents) and owners
(sources). A value that many owners share is a copied example, and so is one that stands in far more repositories than its
owners would put a credential of their own in; one that belongs to few looks live. Ownership decides on the spans that this
method adds to the base ones: long mixed tokens and bearer strings count only while they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Base kinds in their order, with their expressions; then the kinds that the method adds.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
BEARER = "(?:ghp_|gho_|sk_live_|sk-|xox[abp]-|glpat-)[A-Za-z0-9_-]{16,}"
MIXED = "[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "bearer", "mixed")
#: A value of this many owners or more is a copied example; and so is one of this many repositories or more for each owner.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 100


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """kind, and an array of gap (code points since the match before) and value of each match, leftmost and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    pairs = F.zip_with(between, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    # most texts have no match and skip all this
    return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(pattern), pairs).alias("pairs"))


def _assign_value(s: Column) -> Column:
    return F.regexp_extract(s["value"], ASSIGN_VALUE, 1)


def candidates(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two saved tables: row, doc_id, source, a row for each row of documents; and row, doc_id, source, s (kind, start, end
    in code points, end exclusive, value), a row for each span of the base kinds and each that the method may add.

    Offsets are running sums over a text's matches of one kind, so the work is linear in them, however many."""
    docs = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    patterns = (ASSIGN, ACCESS, HEX, BEARER, MIXED)
    found = docs.select("doc_id", "source", F.filter(F.array(*[_matches(text, p, k) for k, p in enumerate(patterns)]), lambda m: m["pairs"].isNotNull()).alias("found"))
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "matches")
    kinds = found.where(F.size("found") > 0).select("row", "doc_id", "source", F.explode("found").alias("m"))
    each = kinds.select("row", "doc_id", "source", F.col("m.kind").alias("kind"), F.posexplode("m.pairs").alias("at", "p"))
    upto = F.sum(F.col("p.gap") + F.length("p.value")).over(Window.partitionBy("row", "kind").orderBy("at")).cast("int")
    each = each.withColumn("end", upto)
    s = F.struct("kind", (F.col("end") - F.length("p.value")).alias("start"), "end", F.col("p.value").alias("value"))
    spans = each.select("row", "doc_id", "source", s.alias("s"))
    k, value = F.col("s.kind"), F.col("s.value")
    fits = F.when(k == 0, F.length(_assign_value(F.col("s"))) >= 12).when(k == 1, F.length(value) >= 18).when(k == 4, value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")).otherwise(True)
    return found.select("row", "doc_id", "source"), saved(spans.where(fits), "spans")


def _value(s: Column) -> Column:
    return F.when(s["kind"] == 0, _assign_value(s)).otherwise(s["value"])


def ownership(spans: DataFrame) -> DataFrame:
    """hash of a candidate value, repositories, owners: distinct documents and sources that hold it. Pairs are made
    distinct first, so a value that a third of all rows hold is counted in parts. A null counts as one of its own."""
    each = spans.select("doc_id", "source", F.xxhash64(_value(F.col("s"))).alias("hash"))
    repos = each.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "source").agg(F.count("one").alias("documents"))
    return owners.groupBy("hash").agg(F.sum("documents").alias("repositories"), F.count("documents").alias("owners"))


def copied(copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> Column:
    """The verdict on a value by its owners and repositories."""
    return (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories * F.col("owners"))


def secrets(documents: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """A row for each row of documents: doc_id, base (spans of the base kinds by start, then kind), spans (base and added ones),
    n_live and n_copied (spans whose value looks live or copied).

    Null and empty texts have none. Spans of one start are ordered by kind, so there are no ties. A text of any number of
    matches is one task's work, linear in them."""
    rows, spans = candidates(documents)
    owned = ownership(spans).select("hash", copied(copied_owners, copied_repositories).alias("copied"))
    judged = spans.withColumn("hash", F.xxhash64(_value(F.col("s")))).join(owned, "hash")
    base = F.col("s.kind") < 3
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(base, F.col("s"))).alias("base"),
        F.collect_list(F.when(base | ~F.col("copied"), F.col("s"))).alias("spans"),
        F.count_if(~F.col("copied")).alias("n_live"),
        F.count_if("copied").alias("n_copied"),
    )
    by_start = lambda c: F.transform(F.array_sort(F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    none = F.array().cast(spans.select(F.array("s")).schema[0].dataType)
    j = rows.select("row", "doc_id").join(by_row, "row", "left")
    return j.select("doc_id", *[F.coalesce(by_start(F.col(c)), none).alias(c) for c in ("base", "spans")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied")])


def listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """secrets() of all documents: nulls, empty and long texts, repeated rows and empty tables as there."""
    d = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied")
