"""Nulls, empty and very long texts, repeated rows, ties, columns with clashing names: defined values of every operator."""

import pytest
from pyspark.sql import functions as F

from lanternflow.llm import common, decontam, langid, license, linededup, mixing, qrules, quality, secrets, simhash, toxicity
from lanternflow.llm.labelled import training_rows

CLASHING = "row s hash found n_words score labels bound part rank copies mean dual key at near far fp label text_hash base spans kept source_size target taken votes x y __id __hash __text __lang __source __q_n_words __t_mark_ratio_high other0 n_lines".split()
LONG = " ".join(f"word{i % 5003} and" for i in range(300_000))  # over 3 MB, 600,000 words
ROWS = [(1, None, "s", "en"), (2, "", "s", "en"), (3, LONG, None, None), (None, "plain words of a text", "s", "en"), (5, "plain words of a text", "s", "en"), (5, "plain words of a text", "s", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string").repartition(3).cache()


@pytest.fixture(scope="module")
def operators(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "plain words of a text"), (2, None), (3, "")], "item_id long, text string")
    quality_rows, toxic_rows = training_rows(odd, labels, "quality", 100), training_rows(odd, labels, "toxic", 100)
    known = odd.where("lang is not null and text <> ''").select("doc_id", "text", "lang")
    return {
        1: lambda d: decontam.contamination(d, bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated"),
        2: lambda d: simhash.near_duplicates(d).select("doc_id", "fp", "component_id"),
        3: lambda d: quality.scores(d, quality_rows).select("doc_id", F.round("score", 9).alias("score")),
        4: lambda d: linededup.deduplicated(d).select("doc_id", F.length("text").alias("n"), "n_lines", "n_dropped"),
        5: lambda d: license.licenses(d).select("doc_id", "n_words", "n_base", "labels", "score"),
        6: lambda d: langid.languages(d, known).select("doc_id", "lang_pred", F.round("score", 6).alias("score")),
        7: lambda d: mixing.mixed(d).select("doc_id", "source", "size", "source_size", "target", "taken"),
        8: lambda d: secrets.secrets(d).select("doc_id", secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_copied"),
        9: lambda d: qrules.rules(d).select("doc_id", "n_words", "word_chars", "base_failed", "kept"),
        10: lambda d: toxicity.scores(d, toxic_rows).select("doc_id", F.round("score", 9).alias("score")),
    }


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("number", range(1, 11))
def test_clashing_columns_change_nothing(odd, operators, number):
    want = rows(operators[number](odd))
    wide = odd.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    assert len(want) == len(ROWS) and rows(operators[number](wide)) == want
    none = operators[number](wide.limit(0))
    assert none.count() == 0 and none.columns == operators[number](odd).columns


def of(operators, odd, number, column):
    found = {}
    for r in operators[number](odd).collect():
        found.setdefault(r.doc_id, []).append(r[column])
    return found


def test_values(operators, odd):
    assert of(operators, odd, 1, "n_hit") == {1: [0], 2: [0], 3: [0], None: [5], 5: [5, 5]}
    fp, component = of(operators, odd, 2, "fp"), of(operators, odd, 2, "component_id")
    assert fp[1] == fp[2] == [0] and component == {1: [1], 2: [1], 3: [3], None: [5], 5: [5, 5]}
    assert fp[3][0] % 2**64 == simhash.fingerprint(LONG)
    for number in (3, 10):  # null and empty texts score alike
        score = of(operators, odd, number, "score")
        assert score[1] == score[2] and score[5][0] == score[5][1] == score[None][0] and all(0 <= x <= 1 for v in score.values() for x in v)
    assert of(operators, odd, 4, "n_lines") == {1: [1], 2: [1], 3: [1], None: [1], 5: [1, 1]} and of(operators, odd, 4, "n")[3] == [len(LONG)]
    assert of(operators, odd, 5, "n_words") == {1: [0], 2: [0], 3: [600_000], None: [5], 5: [5, 5]} and of(operators, odd, 5, "labels")[3] == [""]
    assert of(operators, odd, 6, "lang_pred") == {1: ["und"], 2: ["und"], 3: ["en"], None: ["en"], 5: ["en", "en"]}
    taken, size = of(operators, odd, 7, "taken"), of(operators, odd, 7, "size")
    assert taken[1] == taken[2] == [0] and size[3] == [600_000] and all(t <= 2 * s for k in size for t, s in zip(taken[k], size[k], strict=True))
    assert set(sum(of(operators, odd, 8, "spans").values(), [])) == {""}
    assert of(operators, odd, 9, "n_words")[3] == [600_000] and of(operators, odd, 9, "kept")[1] == [False] and of(operators, odd, 9, "base_failed")[3] == [True]


def test_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    sizes = [b.num_rows for b in common.sliced(pa.RecordBatch.from_arrays([pa.array(["x" * 1_000_000] * 40)], names=["t"]))]
    assert sum(sizes) == 40 and max(sizes) <= 8 and [b.num_rows for b in common.sliced(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"]))] == [0]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_folder(Session())
