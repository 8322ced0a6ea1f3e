import random

import duckdb
from pyspark.sql import functions as F

from lanternflow.functions import names as N
from lanternflow.functions import similarity as S


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_names(spark):
    assert one(spark, ["Волков", "P.L.C.", "PLC", "Écôle Ltd", "Regent Group", "Ltd", "", None, "щука"], N.normalize_name) == ["volkov", "plc", "plc", "ecole", "regent group", "ltd", "", "", "shchuka"]
    assert one(spark, ["Suite 3, 15 St Botolph Street, London"], N.normalize_address) == ["botolph london"]
    assert one(spark, ["1968-04-11x", " 1968-04 ", "1968", "68", None], N.normalize_birth_date) == ["1968-04-11", "1968-04", "1968", "", ""]
    assert one(spark, [" gb-eng", None], N.normalize_jurisdiction) == ["GB", ""]
    assert one(spark, ["AB-12.3", None], N.normalize_identifier) == ["ab123", ""]


def test_sounds(spark):
    assert one(spark, ["volkov", "wolkow", "kuznetsova", "kouznetsova", ""], N.soundex) == ["V421", "V421", "K253", "K253", ""]
    assert one(spark, ["3com", "abc123", "studio54", "jkar", "100", None], N.soundex) == ["K500", "A120", "S330", "I260", "", ""]
    assert one(spark, ["100 200", "Studio 54 Volkov", ""], N.phonetic_key) == ["", "S330-V421", ""]


def reference_sound(token: str) -> str:
    """Letter by letter, in plain Python."""
    codes = {c: k for k, v in {"1": "bfpvw", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in v}
    letters = [c for c in token if "a" <= c <= "z"]
    if not letters:
        return ""
    first = {"w": "v", "c": "k", "y": "i", "j": "i", "q": "k", "x": "s"}.get(letters[0], letters[0])
    said, last = "", codes.get(first, "")
    for c in letters[1:]:
        if c != "h":
            code = codes.get(c, "")
            said += code if code != last else ""
            last = code
    return (first.upper() + said + "000")[:4]


def test_sounds_of_random_tokens(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randrange(1, 9))) for _ in range(3000)]
    assert one(spark, tokens, N.soundex) == [reference_sound(t) for t in tokens]


def test_jaro_winkler_is_that_of_duckdb(spark):
    words = ["martha", "marhta", "dixon", "dicksonx", "jellyfish", "smellyfish", "", "a", "ab", "northwind", "nortwhind", "aaaa", "aa"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", S.jaro(F.col("a"), F.col("b")).alias("j"), S.jaro_winkler(F.col("a"), F.col("b")).alias("w")).collect():
        j, w = duckdb.execute("select jaro_similarity(?, ?), jaro_winkler_similarity(?, ?)", [r.a, r.b, r.a, r.b]).fetchone() if r.a != r.b else (1.0, 1.0)
        assert abs(r.j - j) < 1e-9 and abs(r.w - w) < 1e-9, (r.a, r.b)


def test_birth_dates(spark):
    d = spark.createDataFrame([("1968-04", "1968-04-11"), ("", "1968"), ("1968", "1975"), ("1968", "1968-01"), ("1968-04-11", "1968-04-11")], "a string, b string")
    assert [r[0] for r in d.select(S.birth_date_agreement(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0, -1.0, 0.4, 1.0]
