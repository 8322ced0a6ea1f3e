"""The pipeline against a brute-force version of its stages on a small fixture."""

import collections
import re

import corpus_pipeline
import __spark_entry__
from lanternflow.llm import decontam, linededup, mixing, qrules, simhash

from .test_pair_operators import brute_components, water_level


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_decontaminated(texts: dict, items: list) -> dict:
    """Windows as tuples of words; hit words are cut with what is between neighbours, as the stage leaves it."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: [m[0] for m in word.finditer((t or "").translate(LOWER))]
    windows: dict = {}
    for i, t in enumerate(items):
        w = split(t)
        for at in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[at : at + 8]), set()).add(i)
    lengths = {len(x) for x in windows}
    out = {}
    for doc, text in texts.items():
        w = split(text)
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if of := windows.get(tuple(w[at : at + n])):
                    found |= of
                    hit |= set(range(at, at + n))
        if len(found) < 2:
            out[doc] = text if not hit else decontam_cut(text, hit, word)
    return out


def decontam_cut(text: str, hit: set, word: re.Pattern) -> str:
    """The text without the spans from the first character of each run of hit words to the start of the word after it."""
    at = [(m.start(), m.end()) for m in word.finditer(text.translate(LOWER))]
    kept, upto, i = [], 0, 0
    while i < len(at):
        if i in hit:
            kept.append(text[upto : at[i][0]])
            while i in hit:
                i += 1
            upto = at[i][0] if i < len(at) else len(text)
        else:
            i += 1
    return "".join([*kept, text[upto:]])


def test_stages_and_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    first = docs
    kept = {r.doc_id for r in qrules.rules(docs).where("kept").collect()}
    a = corpus_pipeline.quality_rules(spark, docs, small).cache()
    assert a.columns == columns and {r.doc_id for r in a.collect()} == kept and 0 < len(kept) < first.count()
    b = corpus_pipeline.line_dedup(spark, a, small).cache()
    lines = {r.doc_id: (r.text or "").split("\n") for r in a.collect()}
    where = {}
    for i, ls in lines.items():
        for x in ls:
            key = x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            where.setdefault(key, set()).add(i)
    gone = {k: max(v) for k, v in where.items() if len(k) >= 20 and len(v) >= 3}
    key_of = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    want = {i: "\n".join(x for x in ls if gone.get(key_of(x), i) == i) for i, ls in lines.items()}
    assert b.columns == columns and {r.doc_id: r.text for r in b.collect()} == want
    c = corpus_pipeline.near_dedup(spark, b, small).cache()
    assert c.columns == columns and sorted(r.doc_id for r in c.collect()) == sorted({x for _, x in brute_components(want).values()})
    d = corpus_pipeline.decontaminate(spark, c, small).cache()
    hit = decontam.contamination(c, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert d.columns == columns and {r.doc_id for r in d.collect()} == {r.doc_id for r in hit.where("not contaminated").collect()}
    assert decontam.contamination(d, spark.read.parquet(f"{small}/benchmark.parquet")).where("n_items > 0").count() == 0
    assert {r.doc_id: r.text for r in d.collect()} == brute_decontaminated({r.doc_id: r.text for r in c.collect()}, [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    mixed = corpus_pipeline.mix_sources(spark, d, small).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    source = {r.doc_id: r.source for r in d.collect()}
    for r in d.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in mixed:
        assert r.source == source[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = water_level(dict(sizes))
    largest = max(r["size"] for r in mixed)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= largest for s in want)
    e = {(r.doc_id, r.taken) for r in corpus_pipeline.mix_sources(spark, d, small).collect()}
    assert e == {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, small).collect()}
    assert "pipeline" in __spark_entry__.queries() and (linededup, mixing, simhash)
