"""The methods themselves, against brute force and measured cases: pivots, Newton's bracket, ownership, expressions, models."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.llm import common, langid, license, linededup, mixing, quality, secrets, simhash
from lanternflow.llm.labelled import training_rows

from .test_pair_operators import water_level

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# ---- op2 -----------------------------------------------------------------------------------------------------------


def near_texts(n: int = 400) -> list[tuple[int, str]]:
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(60)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(500)}"
        out.append((i, " ".join(t)))
    return out


def test_pivot_table_discards_and_loses_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(near_texts(), "doc_id long, text string")
    counts = {r["pass"]: (r.met, r.discarded) for r in simhash.pivot_counts(docs).collect()}
    assert 0 < counts[1][1] < counts[1][0] and 0 <= counts[2][1] <= counts[2][0]
    with_table = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    # with one pivot far from all the table discards nothing, and the same components come out
    monkeypatch.setattr(simhash, "within_pivots", lambda a, b: F.lit(True))
    assert with_table == {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_pivot_rows_are_distances(spark):
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63 - 1, 50)
    rows = simhash.with_pivots(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()
    for r in rows:
        packed = [b for v in (r.near, r.far) for b in int(v).to_bytes(8, "little", signed=True)]
        assert packed == [((r.fp % 2**64) ^ p).bit_count() for p in simhash.PIVOTS]
    a, b = rng.integers(-(2**63), 2**63 - 1, 2)
    pair = spark.createDataFrame([(int(x),) for x in (a, b, a ^ 7)], "fp long")
    t = simhash.with_pivots(pair)
    both = t.select(*[F.col(c).alias(f"a_{c}") for c in t.columns]).crossJoin(t.select(*[F.col(c).alias(f"b_{c}") for c in t.columns]))
    for r in both.withColumn("ok", simhash.within_pivots("a", "b")).collect():
        want = all(abs((((r.a_fp) % 2**64) ^ p).bit_count() - (((r.b_fp) % 2**64) ^ p).bit_count()) <= simhash.MAX_DISTANCE for p in simhash.PIVOTS)
        assert r.ok == want


def test_labels_without_a_broadcast(spark, monkeypatch):
    """A hot label is dealt to many tasks where its table may not be broadcast; the rows are the same."""
    docs = spark.createDataFrame(near_texts(200), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(common, "fits_broadcast", lambda *a, **k: False)
    assert want == {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_ties_keep_one_row(spark):
    docs = spark.createDataFrame([(1, "same text of words", "b"), (1, "same text of words", "a"), (1, "Same text of words", "c"), (2, "same text of words", "d")], "doc_id long, text string, near string")
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == 1 and kept[0].doc_id == 1 and set(kept[0].asDict()) == {"doc_id", "text", "near"}


# ---- op4 -----------------------------------------------------------------------------------------------------------


def test_lines_of_many_rows_without_id(spark):
    """Rows without id are one document, but each text gets its own list of lines to drop."""
    line, other = "a line that is long enough to count", "another line that is long enough too"
    rows = [(None, f"{line}\nx{i}") for i in range(50)] + [(1, line), (2, f"{line}\n{other}"), (None, other), (3, other)]
    got = collections.Counter((r.doc_id, r.text) for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([*((None, f"x{i}") for i in range(50)), (1, ""), (2, line), (None, ""), (3, other)])


# ---- op5 -----------------------------------------------------------------------------------------------------------


def test_expressions_keep_choices_and_duties_apart():
    many = " OR ".join(["MIT"] * 40)
    assert license.scan(f"SPDX-License-Identifier: {many} OR GPL-3.0-only")[5] == "gpl,mit"
    one, both = license.scan("SPDX-License-Identifier: MIT OR AGPL-3.0"), license.scan("SPDX-License-Identifier: MIT AND AGPL-3.0")
    assert one[5] == both[5] == "agpl,mit" and one[7:] == (0, "(mit OR agpl)") and both[7:] == (3, "(mit AND agpl)")
    assert license.scan("SPDX-License-Identifier: LicenseRef-Mine AND GPL-2.0 WITH Some-exception")[7:] == (1, "(licenseref-mine AND gpl WITH some-exception)")
    assert license.scan("SPDX-License-Identifier: see below")[5:8] == ("", 0.0, None)
    assert license.scan("Both BSD-3-Clause and MPL 2.0 are named here")[5] == "bsd,mpl"
    assert license.family("GPL-9.9+") == ("gpl", 2) and license.family("word") is None


def test_labels_beyond_base_against_brute_force(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    phrases = [(words(p), label) for p, label in [*license.BASE.items(), *license.NOTICES.items()]]
    phrases += [(words(x), label) for label, (_, names) in license.IDENTIFIERS.items() for x in names.split() if len(words(x)) > 1]
    for r in license.op5_licenses(spark, SMALL).collect():
        t = texts[r.doc_id].text
        w = words(t)
        at = collections.defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        want = {label for p, label in phrases if any(w[i : i + len(p)] == p for i in at.get(p[0], ()))}
        for m in re.finditer(r"(?i)SPDX-License-Identifier[ \t]*:?[ \t]*([A-Za-z0-9.+() \t-]+)", t):
            parts = re.findall(r"[()]|[A-Za-z0-9.+-]+", m[1])
            for end in range(len(parts), 0, -1):
                try:
                    want |= license.evaluate(" ".join(parts[:end]))[0]
                    break
                except license.ExpressionError:
                    continue
        assert r.labels == ",".join(sorted(want))


# ---- op7 -----------------------------------------------------------------------------------------------------------


def test_bracket_encloses_the_root(spark):
    """A thousand documents of one word and one of a million: the dual is far below what a fixed bracket would hold."""
    h = spark.createDataFrame([("s", 1, 1000), ("s", 1_000_000, 1), ("t", 5, 10), (None, 7, 3)], "source string, size long, n long")
    goal = spark.createDataFrame([("s", 1_001_000, 100.0), ("t", 50, 75.0), (None, 21, 42.0)], "source string, source_size long, target double")
    got = {r.source: r for r in mixing.duals(h, goal).collect()}
    rate = lambda r, size: min(2.0, math.exp(r.dual * size / r.mean))
    assert all(r.done for r in got.values())
    assert abs(1000 * rate(got["s"], 1) + 1e6 * rate(got["s"], 10**6) - 100) < 1e-4 and abs(rate(got["t"], 5) - 1.5) < 1e-8 and rate(got[None], 7) == 2


def test_a_source_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    h = spark.createDataFrame([("s", 1, 1000), ("s", 9, 100)], "source string, size long, n long")
    with pytest.raises(ArithmeticError, match="1 sources"):
        mixing.duals(h, spark.createDataFrame([("s", 1900, 700.0)], "source string, source_size long, target double"))


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    sizes = {f"s{i:04d}": rng.choice([1, 5, 50, 5000]) * rng.randrange(1, 9) for i in range(700)} | {None: 40, "é": 3, "zero": 0}
    h = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, size long, n long").repartition(9)
    got = {r.source: r.target for r in mixing.targets(h).collect()}
    want = water_level(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_copies_against_brute_force(spark):
    """Rates by bisection and copies by hand, from the sizes alone."""
    rows = mixing.op7_mix_sources(spark, SMALL).collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source_size, r.target].append(r)
    for (_, target), found in by_source.items():
        sizes = [r["size"] for r in found]
        words = lambda d: sum(s * min(2.0, math.exp(min(d * s, 1.0))) for s in sizes)  # noqa: B023, E731
        low, high = -50.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < target else (low, mid)
        capped = target >= 2 * sum(sizes) * (1 - 1e-12)
        due, taken, want = 0.0, 0, {}
        for s, n in sorted(collections.Counter(x for x in sizes if x).items(), reverse=True):
            due += n * s * (2.0 if capped else min(2.0, math.exp(min(high * s, 1.0))))
            want[s] = min(max(math.floor((due - taken) / s + 0.5), 0), 2 * n)
            taken += want[s] * s
        got = collections.Counter()
        for r in found:
            got[r["size"]] += r.copies
            assert r.taken == r.copies * r["size"] and abs(r.copies * len([1 for x in sizes if x == r["size"]]) - want.get(r["size"], 0)) < len([1 for x in sizes if x == r["size"]])
        assert sum(abs(got[s] - c) for s, c in want.items()) <= 2  # ties at a half may fall to either side


# ---- op8 -----------------------------------------------------------------------------------------------------------


def test_owners_and_repositories_decide(spark):
    value = lambda i: f"ghp_{i:02d}" + "Ab1" * 8
    rows = [(i, f"key {value(1)}", "a") for i in range(150)] + [(200 + i, f"key {value(2)}", "a") for i in range(60)]
    rows += [(300 + i, f"key {value(3)}", f"s{i}") for i in range(3)] + [(400 + i, f"key {value(4)}", "ab"[i % 2]) for i in range(150)] + [(600 + i, f"key {value(5)}", "ab"[i % 2]) for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copied = {r.doc_id // 100: r.n_copied > 0 for r in secrets.secrets(docs).where("doc_id % 100 = 0").collect()}
    assert copied == {0: True, 1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True}
    assert {r.doc_id // 100 for r in secrets.secrets(docs, copied_repositories=10**9).where("n_copied > 0").collect()} == {3}


def test_added_spans_against_brute_force(spark, texts):
    got = {r.doc_id: r.spans for r in secrets.op8_secrets(spark, SMALL).collect()}
    found, holders = collections.defaultdict(list), collections.defaultdict(set)
    patterns = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]{16,})", "bearer": f"({secrets.BEARER})", "mixed": f"({secrets.MIXED})"}
    least = {"assign": 12, "access": 18}
    for i, d in texts.items():
        for k, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, d.text, re.A):
                if len(m[1]) >= least.get(kind, 0) and (kind != "mixed" or all(re.search(c, m[1]) for c in ("[A-Z]", "[a-z]", "[0-9]"))):
                    found[i].append((m.start(), k, kind, m.end(), m[1]))
                    holders[m[1]].add((d.source, i))
    live = lambda v: len({s for s, _ in holders[v]}) < secrets.COPIED_OWNERS and len(holders[v]) < secrets.COPIED_REPOSITORIES * len({s for s, _ in holders[v]})
    for i in texts:
        assert got[i] == ",".join(f"{kind}:{a}:{b}" for a, k, kind, b, v in sorted(found[i]) if k < 3 or live(v))


def test_very_many_matches_in_one_text(spark):
    text = " é ".join(f"AKIA{i:08d}ZZ{i:06d}" for i in range(20_000))
    r = secrets.secrets(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).select(F.size("base").alias("n"), F.col("base")[19_999].alias("last")).first()
    assert r.n == 20_000 and (r["last"].start, r["last"].end) == (19_999 * 23, 19_999 * 23 + 20)


# ---- op3, op6 and what they share ----------------------------------------------------------------------------------


def test_samples_are_bounded_by_their_parameter(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", 10).collect()
    assert len({r.doc_id for r in rows}) == len(rows) <= 2 and all(r.y == 1 for r in rows)


def test_quality_against_brute_force(spark, texts):
    """The weights are where the loss of all pairs has no slope, the cut is the quantile, and scores follow from them."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    train = training_rows(docs, labels, "quality", quality.TRAIN_ROWS)
    m = quality.learned(train)
    rows = sorted((r.y, quality.features(r.text)) for r in train.collect())
    y, z = np.array([r[0] for r in rows]), (np.array([r[1] for r in rows]) - m["mean"]) / m["scale"]
    rng = np.random.default_rng(7)
    good, bad = rng.choice(np.flatnonzero(y == 1), quality.PAIRS), rng.choice(np.flatnonzero(y == 0), quality.PAIRS)
    slope = sum((z[a] - z[b]) / (1 + math.exp(min(float((z[a] - z[b]) @ m["w"]), 50.0))) for a, b in zip(good, bad, strict=True)) / quality.PAIRS - quality.RIDGE * m["w"]
    assert np.abs(slope).max() < 1e-4
    assert sum(x @ m["w"] < m["cut"] for x in z) == int((y == 0).sum())
    for r in quality.op3_quality(spark, SMALL).limit(200).collect():
        x = (np.array(quality.features(texts[r.doc_id].text)) - m["mean"]) / m["scale"]
        assert abs(r.score - 1 / (1 + math.exp(-max(-50, min(50, float(x @ m["w"]) - m["cut"]))))) < 1e-9


def test_language_against_brute_force(spark, texts):
    """Cosines of counted n-grams in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where((common.remainder("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    got = {r.doc_id: r for r in langid.op6_language_id(spark, SMALL).collect()}
    for i in sorted(texts)[::25]:
        raw = (" " + re.sub(r"[\W\d_]+", " ", texts[i].text.lower()).strip() + " ").encode()
        v = collections.Counter()
        for at in range(len(raw)):
            for n, salt in ((1, 40), (2, 41), (3, 42)):
                gram = raw[at : at + n]
                if len(gram) == n and not (n == 1 and at in (0, len(raw) - 1)):
                    code = 0
                    for b in gram:
                        code = code * 257 + b
                    v[((code + (1 << salt)) * 0x9E3779B97F4A7C15 % 2**64) >> 52] += 1
        weighed = {k: math.log1p(n) * float(model["idf"][k]) for k, n in v.items()}
        norm = math.sqrt(sum(x * x for x in weighed.values()))
        near = [sum(x * float(c[k]) for k, x in weighed.items()) / norm for c in model["centroids"]]
        assert got[i].lang_pred == model["langs"][near.index(max(near))] and abs(got[i].score - max(near)) < 1e-4


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"plain english words number {i}", "en") for i in range(300)] + [(1000 + i, "ganz andere deutsche wörter über straßen", "de") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(docs, rows=20)["langs"]) == {"en", "de"}
