"""Decontamination, near-duplicates, line dedup, mixing: against SQL, brute force and hand-made cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanternflow.llm import decontam, linededup, mixing, queries, simhash

from ..conftest import duck, rows_of

DOC = "doc_id long, text string, source string, words int, __hash string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f g h i", "x"), (1, "a b c d e f g h i", "x"), (None, None, None), (None, "a b c d e f g h i", None), (2, "", "y"), (3, long, "y"), (4, "X y z! P, q", "x"), (5, "one\ntwo\n\n", "x")]
    return spark.createDataFrame([(*r, 7, "h") for r in rows], DOC)


BENCH = [(1, "x y Z"), (2, "p q"), (3, None), (4, "A b c d e f g h"), (5, "b c d e f g h i"), (6, "")]


def test_contamination_cases(spark, odd):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    r = decontam.contamination(odd, bench).collect()
    assert len(r) == 8
    by = {}
    for x in r:
        by.setdefault(x.doc_id, []).append((x.n_words, x.n_hit, x.item_ids, x.contaminated))
    assert by[1] == [(9, 9, ["4", "5"], True)] * 2 and by[4] == [(5, 5, ["1", "2"], True)]
    assert by[2] == [(0, 0, [], False)] and by[3][0][:3] == (60_000, 0, []) and sorted(by[None])[0] == (0, 0, [], False)
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(odd.limit(0), bench).count() == 0


def test_contamination_without_a_broadcast(spark, odd, small):
    """The shuffled way gives the rows of the broadcast one."""
    both = [(odd, spark.createDataFrame(BENCH, "item_id long, text string")), (spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet"))]
    for docs, bench in both:
        assert rows_of(decontam.contamination(docs, bench, broadcast_rows=-1).toPandas().astype(str)) == rows_of(decontam.contamination(docs, bench).toPandas().astype(str))


def test_decontaminated_cuts_spans(spark):
    docs = spark.createDataFrame([(1, "Keep, this! A b c d e f g h - and this.", 40, "z"), (2, "b c d e f g h i; X y z", 5, "z"), (3, "nothing", 7, "z"), (4, None, None, "z")], "doc_id long, text string, n_chars long, extra string")
    out = {r.doc_id: r for r in decontam.decontaminated(docs, spark.createDataFrame(BENCH, "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == "Keep, this! and this." and out[1].n_chars == 21 and out[3].text == "nothing" and out[4].text is None


def brute_components(texts: dict) -> dict:
    fps = {}
    for i, t in texts.items():
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        shingles = [b" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps[i] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0
    ids = sorted(fps)
    f, up = np.array([fps[i] for i in ids], np.uint64), list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(f[a] ^ f[a + 1 :]) <= 4) + a + 1:
            x, y = sorted((root(a), root(int(b))))
            up[y] = x
    return {i: (format(fps[i], "016x"), ids[root(k)]) for k, i in enumerate(ids)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(260)]
    texts = {}
    for i in range(240):  # a large group of near copies, a chain, copies, short and empty texts, strangers
        if i < 120:
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts[i] = " ".join(t)
        elif i < 180:
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts[i] = "\t".join(base)
        elif i < 200:
            texts[i] = ["", "  \n", "Same text", "same TEXT"][i % 4]
        else:
            texts[i] = " ".join(rng.choice(vocabulary) for _ in range(50))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (format(r.fp % 2**64, "016x"), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_with_random_fingerprints(spark):
    """The link search alone, on fingerprints at all distances."""
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = [s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for s in seeds for _ in range(6)]
    got = {}
    for r in _components(spark, fps):
        got[r.doc_id] = r.component_id
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert got == {i: root(i) for i in range(len(fps))}


def _components(spark, fps):
    frame = spark.createDataFrame([(i, 0, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "doc_id long, text_hash long, fp long")
    old = simhash.fingerprints
    simhash.fingerprints = lambda documents, shingle: documents
    try:
        return simhash.near_duplicates(frame).collect()
    finally:
        simhash.fingerprints = old


def test_near_duplicates_cases(spark, odd):
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == 8 and {x.component_id for x in r if x.fp == 0} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((x.doc_id, x.text) for x in kept.where("doc_id <> 3").collect()) == [(1, "a b c d e f g h i"), (2, ""), (4, "X y z! P, q"), (5, "one\ntwo\n\n")]


def test_lines_cases(spark, odd):
    line = "This LINE is long enough to count"
    rows = [(1, f"{line}\nx"), (2, f"  {line.lower()}\t\n{line}\ny"), (3, line), (None, f"z\n{line}"), (5, "é" * 20), (6, "é" * 20), (7, "É" * 20), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, 1, 5, "a") for i, t in rows], "doc_id long, text string, n_chars long, n_lines int, hash string")
    d = linededup.deduplicated(docs)
    assert d.columns == ["doc_id", "text", "n_chars", "hash", "n_lines", "n_dropped"]
    r = {x.doc_id: (x.text, x.n_lines, x.n_dropped, x.n_chars) for x in d.collect()}
    assert r == {1: ("x", 2, 1, 1), 2: ("y", 3, 2, 1), 3: (line, 1, 0, 33), None: ("z", 2, 1, 1), 5: ("é" * 20, 1, 0, 20), 6: ("é" * 20, 1, 0, 20), 7: ("É" * 20, 1, 0, 20), 8: ("", 1, 0, 0), 9: ("", 1, 0, 0)}
    assert linededup.deduplicated(docs.limit(0)).count() == 0 and linededup.deduplicated(odd).count() == 8


def water_level(sizes: dict, share=1.5, weights=(3, 1, 2), most=2) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in part.items():
            target[s] += x
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def test_mixing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    r = mixing.mixed(docs).toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.select("doc_id", "text").collect()}
    assert dict(zip(r["doc_id"], r["size"], strict=True)) == size
    sums = r.groupby("source")["size"].sum().to_dict()
    want = water_level(sums)
    for s, g in r.groupby("source"):
        assert abs(g["target"].iloc[0] - want[s]) < 1e-6 * max(1, want[s]) and g["source_size"].iloc[0] == sums[s]
        assert abs(g["taken"].sum() - want[s]) <= max(g["size"].max() / 2, 0.02 * want[s])
    assert (r["taken"] <= 2 * r["size"]).all()
    again = mixing.mixed(docs.repartition(7)).toPandas()
    assert rows_of(r) == rows_of(again)


def test_mixing_cases(spark, odd):
    r = mixing.mixed(odd)
    assert r.count() == 8 and r.where("size = 0 and taken > 0").count() == 0 and r.where("source is null").select("target").distinct().count() == 1
    assert mixing.mixed(odd.limit(0)).count() == 0
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text here").alias("text"), F.when(F.col("id") < 2400, "a").otherwise("b").alias("source"))
    sums = {x.source: (x.t, x.w) for x in mixing.mixed(big).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()}
    assert all(abs(t - w) <= 3 for t, w in sums.values())
