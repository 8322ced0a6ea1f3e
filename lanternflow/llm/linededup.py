"""Line deduplication over the whole corpus.

Lines are exploded as 128-bit hashes of their keys, counted by distinct documents (pre-aggregated before each shuffle),
and the frequent ones come back to their documents as a list of hashes to drop. A text moves once, to meet that list.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved, set_aside

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
_BLANKS = b" \t\n\v\f\r"


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _keys(lines: list[bytes], min_length: int) -> list[bytes | None]:
    """For each line the hash of its key, or None if the key is too short to count."""
    found: list[bytes | None] = []
    for line in lines:
        key = line.strip(_BLANKS).lower()  # on bytes, lower() changes A-Z alone
        long = len(key) >= min_length and len(key.decode("utf-8", "surrogatepass")) >= min_length
        found.append(xxhash.xxh3_128_digest(key) if long else None)
    return found


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def frequent_lines(documents: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, text_hash, hash: for each frequent key, every text that has it but those of the largest doc_id with it.

    A null doc_id is a document of its own, smaller than all others; its texts stay apart by their hash, as a third of all
    rows may have no id."""

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, out = [], [], []
        for i, text_hash, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            found = {k for k in _keys(_lines(text), min_length) if k}
            ids.extend([i] * len(found))
            texts.extend([text_hash] * len(found))
            out.extend(found)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "text_hash", "hash"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    # a key that is frequent for sure has many rows; counts come from partial sums, so no task gets a key's rows
    pairs = saved(mapped(docs, hashes, "doc_id bigint, text_hash bigint, hash binary"), "lines")
    # the frequent keys are tables of their own: then both sides of a join are plain shuffles, and adaptive execution can
    # split the rows of a hot key, or broadcast the keys if they are few
    counts = saved(pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_documents).select("hash"), "keys")
    some = pairs.join(counts, "hash", "left_semi")
    some = saved(some.groupBy("hash", "doc_id", "text_hash").agg(F.lit(1).alias("one")), "some")
    by_document = some.groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    keep = saved(by_document.groupBy("hash").agg(F.count("one").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_documents).select("hash", "last"), "keep")
    return some.join(keep, "hash").where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "text_hash", "hash")


def deduplicated(documents: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """documents with text cut to its kept lines, plus n_lines and n_dropped (an input column of that name is replaced).

    A null or empty text is one empty line, which stays; its text becomes empty. Rows that repeat a doc_id lose the same
    lines. There are no ties: of the documents with a key the largest doc_id keeps it. A very long text is cut by one task. n_chars, if it is there, follows the text."""
    drops = frequent_lines(documents, min_length, min_documents).groupBy("doc_id", "text_hash").agg(F.collect_list("hash").alias("__hashes"))
    drops = saved(drops, "drops").withColumnsRenamed({"doc_id": "__id", "text_hash": "__text"})
    whole = documents.drop("n_lines", "n_dropped")
    docs = set_aside(whole, "doc_id", "text", "n_chars")
    columns = docs.columns
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__text"))
    joined = docs.join(drops.hint("shuffle_hash"), same, "left").drop("__id", "__text")
    at, hashes = columns.index("text"), len(columns)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, totals, dropped, chars = [], [], [], []
        for text, drop in zip(batch.column(at).to_pylist(), batch.column(hashes).to_pylist(), strict=True):
            lines = _lines(text)
            kept = lines
            if drop:
                gone = set(drop)
                kept = [line for line, key in zip(lines, _keys(lines, min_length), strict=True) if key not in gone]
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            totals.append(len(lines))
            dropped.append(len(lines) - len(kept))
            chars.append(len(texts[-1]))
        out = [batch.column(i) for i in range(hashes)]
        out[at] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            out[columns.index("n_chars")] = pa.array(chars, pa.int64())
        return pa.RecordBatch.from_arrays([*out, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    kinds = dict(docs.dtypes) | {"text": "string", "n_chars": "bigint"}
    result = mapped(joined, cut, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_lines bigint, n_dropped bigint")
    return result.toDF(*whole.columns, "n_lines", "n_dropped")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """deduplicated() of all documents: nulls, empty and long texts, repeated rows and empty tables as there."""
    d = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, doc_id, i, ls[i] line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
      from (select *, unnest(range(1, len(ls) + 1)) i from d)),
f as (select k, max(doc_id) last from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select l.*, f.k is not null and l.doc_id <> f.last as gone from l left join f on l.k = f.k)
select doc_id, count(*)::bigint n_lines, sum(gone::int)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from m group by r, doc_id
"""
