"""Operators that judge each text: base columns against plain Python, models on held-out rows, hand-made cases."""

import collections
import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from lanternflow.llm import langid, license, qrules, quality, secrets, toxicity
from lanternflow.llm.labelled import training_rows

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, 3), (None, "", "en", "s", 3), (2, "é " * 40_000, "fr", "s", 3), (2, "é " * 40_000, "fr", "s", 3), (3, "12 !! 34", None, "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def test_licenses(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in license.op5_licenses(spark, LARGER).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].text.translate(lower))
        found = [(i, label) for phrase, label in license.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_expressions():
    assert license.evaluate("MIT OR GPL-3.0-only AND Apache-2.0") == ({"mit", "gpl", "apache"}, 0)
    assert license.evaluate("(MIT OR GPL-3.0-only) AND AGPL-3.0") == ({"mit", "gpl", "agpl"}, 3)
    assert license.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl"}, 1)
    for bad in ("MIT MIT", "OR", "(MIT", "MIT)", "MIT AND", "", "foo"):
        with pytest.raises(license.ExpressionError):
            license.evaluate(bad)
    assert license.scan("x\n# SPDX-License-Identifier: MIT OR Apache-2.0 applies here")[5] == "apache,mit"
    assert license.scan("mit license mit license")[1:4] == (2, 0, 2)


def test_long_expressions():
    many = " AND ".join(["MIT"] * 300)
    assert license.scan(f"SPDX-License-Identifier: {many} AND AGPL-3.0-only")[5::2] == ("agpl,mit", 3)
    assert license.scan(f"SPDX-License-Identifier: ({many} AND AGPL-3.0-only) applies")[5::2] == ("agpl,mit", 3)
    assert license.scan("SPDX-License-Identifier: " + "(" * 5000 + "MIT" + ")" * 5000)[5::2] == ("mit", 0)

    def shortened(parts: list[str]) -> tuple[set[str], int] | None:
        for end in range(len(parts), 0, -1):
            try:
                return license.evaluate(" ".join(parts[:end]))
            except license.ExpressionError:
                continue
        return None

    rng = random.Random(3)
    for _ in range(4000):
        parts = rng.choices(["MIT", "GPL-2.0", "unknown", "OR", "AND", "with", "(", ")"], [4, 4, 2, 4, 4, 2, 2, 3], k=rng.randrange(1, 25))
        assert license.longest_expression(" ".join(parts)) == shortened(parts)


def test_secrets(spark, texts):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for r in secrets.op8_secrets(spark, LARGER).collect():
        t = texts[r.doc_id].text
        base = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, t, re.A) if len(m[2]) >= 12]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = [f"{k}:{a}:{b}" for a, _, k, b in sorted(base)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(",")) | {""}
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]


def test_secret_ownership(spark):
    shared, own = "ghp_" + "Ab1" * 8, "ghp_" + "Zy9" * 8
    rows = [(i, f"key {shared}", f"s{i}") for i in range(4)] + [(9, f"key {own} é {own}", "s0"), (10, None, None)]
    r = {x.doc_id: x for x in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", secrets.listed(secrets.F.col("spans")).alias("s"), "n_live", "n_copied").collect()}
    assert r[0].s == "" and r[0].n_copied == 2 and r[9].s == "bearer:4:32,mixed:4:32,bearer:35:63,mixed:35:63" and r[10].s == ""


def test_quality_rules(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    clean_lost = junk_kept = 0
    for r in qrules.op9_quality_rules(spark, LARGER).collect():
        t = texts[r.doc_id].text
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
        clean_lost += labels.get(r.doc_id) == 1 and not r.base_failed and not r.kept
        junk_kept += labels.get(r.doc_id) == 0 and r.kept
    assert clean_lost <= 2 and junk_kept <= 2


def prose(rng: random.Random, n: int = 80, marked: int = 10) -> list[str]:
    """Words with a capital and a full stop around every run of about marked words."""
    out = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("bcdfglmnprst") * rng.randrange(3) + rng.choice("aeiou") for _ in range(n)]
    for i in range(0, n, marked + rng.randrange(3)):
        out[i], out[i - 1] = out[i].capitalize(), out[i - 1] + "."
    return out


RULED = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("share", [0.3, 0.45])
def test_quality_rules_with_much_junk_in_a_source(spark, share):
    rng = random.Random(7)
    n, junk = 400, int(400 * share)
    rows = [(i, " ".join(w + "#$%&"[: 1 + i % 4] if i < junk else w for w in prose(rng)), "en", "s") for i in range(n)]
    kept = {r.doc_id for r in qrules.rules(spark.createDataFrame(rows, RULED)).where("kept").collect()}
    assert kept == set(range(junk, n))


def test_fences_follow_the_data(spark):
    """Languages of few and of many marks get different fences, and the same text passes in one and fails in the other;
    a source that is like its language but has few documents leans on it; other data move the fences."""
    rng = random.Random(3)
    rows = [(i, " ".join(prose(rng, 200, 16)), "en", "many") for i in range(400)] + [(1000 + i, " ".join(prose(rng, 200, 3)), "de", "many") for i in range(400)]
    rows += [(2000 + i, " ".join(prose(rng, 200, 3)), "en", "few") for i in range(5)]
    probe = " ".join(prose(rng, 200, 2))
    rows += [(5000, probe, "en", "many"), (5001, probe, "de", "many")]
    docs = spark.createDataFrame(rows, RULED)
    f = {(r.lang, r.source): r["__t_mark_ratio_high"] for r in qrules.thresholds(qrules.measured(docs)).collect()}
    assert f["en", "many"] < f["de", "many"] / 1.5 and f["en", "many"] < f["en", "few"] < f["de", "many"]
    kept = {r.doc_id: r.kept for r in qrules.rules(docs).collect()}
    assert not kept[5000] and kept[5001] and all(kept[i] for i in range(400)) and all(kept[1000 + i] for i in range(400))
    assert {r.doc_id for r in qrules.filtered(docs).collect()} == {i for i, k in kept.items() if k}


def bin_of(x: float) -> int:
    return 0 if x <= qrules.FLOOR else math.ceil(math.log(x / qrules.FLOOR) / math.log(qrules.GAMMA))


def test_kept_against_brute_force(spark):
    """Fences and verdicts again, from sorted lists of bins in plain Python."""
    stats = {r.doc_id: (r, d) for r, d in zip(*(sorted(x.collect(), key=lambda r: r.doc_id) for x in (qrules.op9_quality_rules(spark, LARGER), spark.read.parquet(f"{LARGER}/documents.parquet"))), strict=True)}
    counts = {i: dict(zip(qrules.RULES, qrules.statistics(d.text)[-len(qrules.RULES) :], strict=True)) for i, (_, d) in stats.items()}
    step = math.log(qrules.GAMMA)

    def quantiles(found: list[int]) -> tuple[float, float, float]:
        found = sorted(found)
        low, mid, high = (found[-(-len(found) * t // 10) - 1] for t in (1, 5, 9))
        return (len(found) if mid else 0.0, mid * step + math.log(qrules.FLOOR), max(min(mid - low, high - mid), 1) * step)

    groups = collections.defaultdict(list)
    for r, d in stats.values():
        if not r.base_failed:
            for c in qrules.RULES:
                for g in ((), (d.lang,), (d.lang, d.source)):
                    groups[g, c].append(bin_of(r[c]))
    q = {k: quantiles(v) for k, v in groups.items()}
    lean = lambda own, on: [(own[0] * own[k] + qrules.PRIOR * on[k - 1]) / (own[0] + qrules.PRIOR) for k in (1, 2)]
    rejected = 0
    for i, (r, d) in stats.items():
        out = False
        for c, sides in qrules.RULES.items():
            if not r.base_failed:
                by_lang = lean(q[(d.lang,), c], q[(), c][1:])
                mid, spread = lean(q[(d.lang, d.source), c], by_lang)
                reach, margin = qrules.REACH * max(spread, by_lang[1]), 1 + qrules.MARGIN / max(counts[i][c], 1.0) ** 0.5
                out |= ("high" in sides and r[c] / margin > math.exp(mid + reach)) or ("low" in sides and r[c] * margin < math.exp(mid - reach))
        assert r.kept == (not r.base_failed and not out)
        rejected += out
    assert rejected > 10


@pytest.mark.parametrize(("name", "operator", "label", "cut", "least"), [("quality", quality.op3_quality, "quality", 0.5, 0.97), ("toxicity", toxicity.op10_toxicity, "toxic", 0.7, 0.93)])
def test_classifiers_on_held_out_rows(spark, name, operator, label, cut, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = operator(spark, LARGER).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held)


def test_language_on_held_out_rows(spark, texts):
    rows = langid.op6_language_id(spark, LARGER).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    r = langid.languages(odd, odd.where("lang = 'fr'")).collect()
    assert [x.lang_pred for x in sorted(r, key=lambda x: (x.doc_id is None, x.doc_id or 0))] == ["und", "fr", "fr", "und", "und"]
    for out in (license.licenses(odd), secrets.secrets(odd), qrules.rules(odd), quality.scores(odd, training_rows(odd, labels, "quality", 10)), toxicity.scores(odd, training_rows(odd, labels, "toxic", 10))):
        assert out.count() == 5
    none = odd.limit(0)
    for out in (license.licenses(none), secrets.secrets(none), qrules.rules(none), qrules.filtered(none), langid.languages(none, none), quality.scores(none, training_rows(none, labels, "quality", 10)), toxicity.scores(none, training_rows(none, labels.limit(0), "toxic", 10))):
        assert out.count() == 0
    assert qrules.filtered(odd).columns == odd.columns


def test_label_model_joins_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    good = [np.where(rng.random(2000) < 0.9, y, ~y) for _ in range(5)]
    noise = rng.random(2000) < 0.5
    votes = np.array([*good, noise, noise, noise, noise], int).T  # four voters that say the same, and know nothing
    assert ((toxicity.label_model(votes) > 0.5) == y).mean() > 0.95


def test_voters_have_their_own_views():
    votes = lambda t, found=(): {n for n, v in zip(toxicity.VOTERS, toxicity.Voters(list(found))(t), strict=True) if v == 1}
    assert votes("a calm text of some words") == set() and toxicity.Voters()("a calm text")[-1] == 0
    assert votes("You are such an idiot") == {"addressed"} and votes("what an 1d10t he is") == {"disguised"}
    assert votes("I will hurt you tomorrow") == {"threat"} and votes("HEY YOU FOOL, NOW") == {"shouted", "addressed"}
    assert votes("damn this crap") == {"profanity", "dense"} and votes("blarg and blarg", ["blarg"]) == {"mined words", "dense"}
    assert votes("blarging and blarged", ["blarg*"]) == {"mined beginnings", "dense"} and votes(None) == set()


def test_toxic_words_that_no_voter_knows(spark):
    """Without a useful label, and though no lexicon has the word, the classifier learns it from the company that it keeps."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = prose(rng, 60)
        if i < 120:
            for x in (*rng.sample(sorted(toxicity.INSULTS), 2), *["grubskull"] * (i % 5 > 0)):
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w), 0))
    train = spark.createDataFrame(rows, "doc_id long, text string, y int")
    probes = [(1, " ".join([*prose(rng, 40), "grubskull", *prose(rng, 9), "grubskulls", "grubskull"])), (2, " ".join(prose(rng, 60))), (3, "you stupid idiot"), (4, None), (5, "")]
    s = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(probes, "doc_id long, text string"), train).collect()}
    assert s[1] >= 0.5 > 10 * s[2] and s[3] >= 0.7 and s[4] == s[5] < 0.1


def test_near_copies_teach_once(spark):
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = [(i, " ".join([*base[:150], f"x{i}", *base[150:]]), 1) for i in range(40)] + [(100 + i, " ".join(prose(rng, 50)), 0) for i in range(100)]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "doc_id long, text string, y int")).collect()
    assert sum(r.y for r in kept) <= 3 and sum(1 - r.y for r in kept) == 100
