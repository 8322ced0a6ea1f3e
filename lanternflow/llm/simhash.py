"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint has a table row of Hamming distances to reference fingerprints (pivots), made once and stored with
it. By the triangle inequality two fingerprints within the threshold differ by no more than it in every coordinate, so a pair
with a larger coordinate difference is discarded and the survivors are verified. A pivot table alone would still meet all
pairs; so that work does not grow with the square of the corpus, the table is partitioned by block keys: of BLOCKS bit
blocks, at most threshold differ, so at least KEEP whole blocks agree, and each choice of KEEP blocks is a key. No pair is
lost by that.

Groups under one key are never paired out in full. In a first, linear pass over rows sorted by key, each row is held
against the rows just before it and forests of links come out. Components of those links then decide what is left: in a
key whose members already are in one component nothing is left to find; elsewhere only members outside the key's largest
component meet the others. That second pass is exact, the first only saves work. Both prune by the stored coordinates.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_label, mapped, put_back, saved, set_aside

SHINGLE = 4
MAX_DISTANCE = 4
BLOCKS = 7
BACK = 8
AT_ONCE = 16_384
PIVOTS = tuple((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(16))
_LOW = np.uint64(0x0101010101010101)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of each bit over XXH64 (seed 42) of the word shingles; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter([h64(whole[a:b], 42) for a, b in zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(found) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # eight one-byte counters in a word hold 255 at most
        part = h[at : at + 255]
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _LOW).sum(dtype=np.uint64)
            counts[bit::8] += np.frombuffer(np.array([lanes], "<u8").tobytes(), np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (of the text; with doc_id it names a row), fp: the fingerprint as a signed long."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_signed(fingerprint(t, shingle)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return mapped(docs, of, "doc_id bigint, text_hash bigint, fp bigint")


def block_masks(blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> list[int]:
    """A mask of bits for each choice of blocks - max_distance whole blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(parts[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - max_distance)]


def _keyed(nodes: DataFrame) -> DataFrame:
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(block_masks())])
    each = nodes.withColumn("m", F.explode(masks))
    return each.select("*", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bits")).drop("m")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the pivots: a row of bytes for each."""
    return np.bitwise_count(fps[:, None] ^ np.array(PIVOTS, np.uint64)[None, :])


def with_pivots(nodes: DataFrame) -> DataFrame:
    """nodes (a row for each fingerprint fp) with its row of the pivot table, eight distances of a byte each in near and far."""
    names = nodes.columns

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.ascontiguousarray(batch.column(names.index("fp")).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
        packed = np.ascontiguousarray(pivot_table(fps).astype(np.uint8)).view("<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed[:, 0], pa.int64()), pa.array(packed[:, 1], pa.int64())], names=[*names, "near", "far"])

    return mapped(nodes, of, ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes) + ", near bigint, far bigint")


def within_pivots(a: str, b: str) -> Column:
    """Whether no coordinate of the stored rows a.near, a.far and b.near, b.far differs by more than the threshold."""
    ok = F.lit(True)
    for part in ("near", "far"):
        for i in range(8):
            at = lambda side: F.shiftrightunsigned(F.col(f"{side}_{part}"), 8 * i).bitwiseAND(F.lit(255))  # noqa: B023, E731
            ok = ok & (F.abs(at(a) - at(b)) <= MAX_DISTANCE)
    return ok


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The batches' integer columns as arrays of at least AT_ONCE rows, but for the last."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], 1))
        if sum(map(len, held)) >= AT_ONCE:
            yield np.concatenate(held)
            held = []
    if sum(map(len, held)):
        yield np.concatenate(held)


def _links_of(rows: np.ndarray, new: int = 0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of rows sorted by key: whether a row has a neighbour of its key, the first row that it is linked to (or itself), and
    how many pairs with a row from new on were met under a key and how many of them the pivot table discarded."""
    n, met, discarded = len(rows), 0, 0
    fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
    table = np.ascontiguousarray(rows[:, 3:5]).view(np.uint8).astype(np.int16)
    near, parent = np.zeros(n, bool), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for back in range(1, min(BACK, n - 1) + 1):
        pair = np.flatnonzero((rows[back:, :2] == rows[:-back, :2]).all(1))
        if back == 1:
            near[pair] = near[pair + 1] = True
        fresh = pair + back >= new
        kept = (np.abs(table[pair + back] - table[pair]) <= MAX_DISTANCE).all(1)
        met, discarded = met + int(fresh.sum()), discarded + int((fresh & ~kept).sum())
        pair = pair[kept]
        pair = pair[np.bitwise_count(fp[pair + back] ^ fp[pair]) <= MAX_DISTANCE]
        for a in pair.tolist():
            x, y = root(a), root(a + back)
            parent[max(x, y)] = min(x, y)
    links = np.arange(n)
    for i in np.flatnonzero(near).tolist():
        links[i] = root(i)
    return near, links, met, discarded


_FOUND = "choice int, bits bigint, fp bigint, other bigint, met bigint, discarded bigint"


def _first_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by choice, bits, fp -> rows of keys that have several rows, each with a linked row before it or null.

    Keeps BACK rows from one array to the next, the last of them not yet decided on. The first and the last row of a
    partition come out in any case, as their key may go on in another one. The first row that comes out of each array also
    has the counts of pairs met and discarded."""
    kept = np.zeros((0, 5), np.int64)

    def out(rows: np.ndarray, links: np.ndarray, where: np.ndarray, met: int = 0, discarded: int = 0) -> pa.RecordBatch:
        other = pa.array(rows[links[where], 2], pa.int64(), mask=links[where] == where)
        first = (np.arange(len(where)) == 0).astype(np.int64)
        columns = [rows[where, 0].astype(np.int32), rows[where, 1], rows[where, 2], other, first * met, first * discarded]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["choice", "bits", "fp", "other", "met", "discarded"])

    for new in _gathered(batches):
        rows, k = np.concatenate([kept, new]), len(kept)
        near, links, met, discarded = _links_of(rows, k)
        if not k:
            near[0] = True
        near[: max(k - 1, 0)] = False  # these came out before
        near[-1] = False  # decided with what follows
        yield out(rows, links, np.flatnonzero(near), met, discarded)
        kept = rows[-BACK:]
    if len(kept):
        yield out(kept, _links_of(kept)[1], np.array([len(kept) - 1]))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, label: the smallest node reachable over the links, for each node that has a link.

    Each round takes the smallest label among neighbours and then jumps to that label's own label; it ends when no label
    changes. All in tables; only a count comes to the driver."""
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        over = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        least = over.unionByName(labels).groupBy("node").agg(F.min("label").alias("low"))
        least = saved(least, "least")
        # a label's own label, for those that have a smaller one: looked up once for each, however many nodes have it
        jump = least.select("low").distinct().join(least.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low").where("lower < low")
        new = at_label(least, saved(jump, "jump"), "low", "node").select("node", F.coalesce("lower", "low").alias("label"))
        new = saved(new, "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def _first_pass(nodes: DataFrame) -> DataFrame:
    """The saved rows of _first_links() for nodes: fp, near, far."""
    sort = ["choice", "bits", "fp"]
    keyed = _keyed(nodes.select("fp", "near", "far")).select("choice", "bits", "fp", "near", "far")
    return saved(keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_first_links, _FOUND), "pairs")


def _second_pass(nodes: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, a_label, b_label and the pivot rows of both) that the first pass left open: in keys of several
    components, members outside the largest one against the members of other components."""
    members = rows.select("choice", "bits", "fp").distinct().join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    members = saved(members, "members")
    sizes = members.groupBy("choice", "bits", "label").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1").select("choice", "bits", F.col("top.label").alias("top"))
    open_keys = saved(members.join(several, ["choice", "bits"]).join(nodes.select("fp", "near", "far"), "fp"), "open")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("label", "near", "far")]
    left = open_keys.where("label <> top").select("choice", "bits", F.col("fp").alias("a"), *side("a"))
    right = open_keys.select("choice", "bits", F.col("fp").alias("b"), *side("b"))
    return left.join(right, ["choice", "bits"]).where("a_label <> b_label")


def pivot_counts(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row: pass (1), met (pairs under a key that the linear pass held against each other), discarded (by the pivot table
    alone); and one for pass 2. What is not discarded is verified bit by bit. Of no pairs both are 0."""
    nodes = saved(with_pivots(fingerprints(documents, shingle).select("fp").distinct()), "nodes")
    rows = _first_pass(nodes)
    labels = components(rows.where("other is not null").select("fp", "other").distinct(), "fp", "other")
    pairs = _second_pass(nodes, rows, labels)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    first = rows.agg(F.lit(1).alias("pass"), count(F.col("met")).alias("met"), count(F.col("discarded")).alias("discarded"))
    return first.unionByName(pairs.agg(F.lit(2).alias("pass"), F.count(F.lit(1)).alias("met"), count((~within_pivots("a", "b")).cast("int")).alias("discarded")))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of documents: doc_id, text_hash, fp, component_id (the smallest doc_id reachable over links of
    at most MAX_DISTANCE bits; null if no document of the component has an id) and keep_hash (the smallest text_hash
    among rows with that id).

    Null and empty texts have fingerprint 0 and link like others. Repeated rows each have a result row. Tied texts of one
    id and hash are the same row for this purpose. A very long text is one task's work, once."""
    docs = saved(fingerprints(documents, shingle), "fingerprints")
    grouped = docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("best"))
    nodes = grouped.select("fp", "least", F.col("best.n").alias("no_id"), F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"))
    nodes = saved(with_pivots(nodes), "nodes")
    rows = _first_pass(nodes)
    labels = components(rows.where("other is not null").select("fp", "other").distinct(), "fp", "other")
    near = within_pivots("a", "b") & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    rest = _second_pass(nodes, rows, labels).where(near).select("a_label", "b_label").distinct()
    merged = components(rest, "a_label", "b_label")
    # rows of one label may be a third of all: its final label and its least id come from small tables of one row a label
    linked = nodes.select("fp", "least", "no_id", "best_id", "best_hash").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.withColumn("label", F.coalesce("label", "fp"))
    linked = at_label(linked, merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "fp")
    linked = saved(linked.withColumn("label", F.coalesce("top", "label")).drop("top"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.min(F.struct("no_id", "best_id", "best_hash")).alias("best"), F.count(F.lit(1)).alias("n"))
    several = saved(least.where("n > 1").select("label", "component_id", F.col("best.best_hash").alias("keep_hash")), "several")
    named = at_label(linked, several, "label", "fp").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("keep_hash", "best_hash").alias("keep_hash"))
    return docs.join(saved(named, "components"), "fp").select("doc_id", "text_hash", "fp", "component_id", "keep_hash")


def one_of_each(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """documents with one row of each component: the one with the smallest doc_id (null ids last), and among rows with
    that id the one with the smallest hash of its text. Columns stay as they are."""
    found = near_duplicates(documents, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash")))
    kept = saved(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "kept")
    side = kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    docs = set_aside(documents, "doc_id", "text")
    result = docs.join(side.hint("shuffle_hash"), on, "left_semi")
    if kept.where("n > 1").limit(1).count():  # whole rows are repeated
        result = result.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__hash"])
    return put_back(result, docs, documents)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents: nulls, empty and long texts, ties, repeated rows and empty tables as there."""
    d = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
