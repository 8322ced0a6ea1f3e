"""Quality rules with adaptive thresholds.

Per-document statistics become ratios that are above zero in ordinary prose. A ratio's distribution per language and
source is kept as a mergeable quantile sketch: counts of logarithmic bins (relative error GAMMA - 1), so sketches of
parts, of sources and of languages add up and a rerun gives the same thresholds. All thresholds come from the sketches:

* the middle of a group is its median, its spread the smaller of median / lowest tenth and highest tenth / median. Junk
  lies on one side of a ratio, so it widens neither while it is less than half of a group;
* a group's logarithms of these are averaged with its language's, and the language's with those of all, with the weight
  of the group's documents against PRIOR documents: small groups lean on larger ones, without a size at which that turns;
* a group's spread is no less than its language's, as copies may narrow it; the fences are median * spread ** +-REACH.

A document's own ratio is a count of few or many words. It fails a rule if it is beyond the fence by more than MARGIN
standard errors of that count. Thresholds, a row per language and source, are joined to the documents and filter them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import blank_split, mapped, put_back, saved, set_aside, sized

GAMMA = 1.02
FLOOR = 1e-4
REACH = 4.0
MARGIN = 2.0
PRIOR = 200.0
#: ratio -> which fences it has. The ratios are shares of ASCII marks among the characters of words, of A-Z among ASCII
#: letters, of the most frequent word and of words that differ from the one before, and the mean length of a word.
RULES = {"mark_ratio": "high", "upper_ratio": "high", "top_word_ratio": "high", "change_ratio": "low", "word_length": "high low"}
FENCES = [f"{c}_{side}" for c, sides in RULES.items() for side in sides.split()]
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATIOS = [*RULES, *(f"n_{c}" for c in RULES)]
_KINDS = ", ".join(f"{c} bigint" for c in _STATS) + ", " + ", ".join(f"{c} double" for c in _RATIOS)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _repeated(ids: np.ndarray, window: int = 8) -> int:
    """Words in windows that stand twice or more. Windows are numbered exactly, by doubling from 1 word to 8."""
    grams, width = ids, 1
    while width < window:
        grams = np.unique(grams[:-width] * (int(grams.max()) + 1) + grams[width:], return_inverse=True)[1]
        width *= 2
    again = np.flatnonzero(np.bincount(grams)[grams] > 1)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the ratios of RULES, then the counts behind them."""
    words = blank_split(text)
    n = len(words)
    raw = (text or "").encode("utf-8", "surrogatepass")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    if not n:
        return 0, 0, symbols, 0, 0, *(0.0,) * len(_RATIOS)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = _repeated(ids) if n >= 8 else 0
    without = lambda some: len(joined) - len(joined.translate(None, some))
    marks, upper, letters = without(_MARKS), without(_UPPER), without(_LETTERS)
    top, changes = int(np.bincount(ids).max()), 1 + int((ids[1:] != ids[:-1]).sum())
    ratios = marks / chars, upper / max(1, letters), top / n, changes / n, chars / n
    return n, chars, symbols, dup, repeated, *ratios, *map(float, (marks, upper, top, changes, n))


def measured(documents: DataFrame, texts: bool = False) -> DataFrame:
    """The statistics of each row beside its doc_id, lang and source; or, with texts, beside all its columns, as a struct __q."""
    docs = documents if texts else documents.select("doc_id", "lang", "source", "text")
    at = docs.columns.index("text")
    columns = docs.columns
    names = [c for c in columns if texts or c != "text"]

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column(at).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (len(_STATS) + len(_RATIOS))
        made = [pa.array(c, pa.int64() if i < len(_STATS) else pa.float64()) for i, c in enumerate(cols)]
        kept = [batch.column(i) for i, c in enumerate(columns) if c in names]
        return pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *("__q_" + c for c in [*_STATS, *_RATIOS])])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + ", ".join(f"__q_{x}" for x in _KINDS.split(", "))
    return mapped(docs, of, schema)


def base_failed() -> Column:
    return (F.col("__q_n_words") < 20) | (100 * F.col("__q_n_repeat_words") > 30 * F.col("__q_n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n: mergeable by adding n. Rows that fail the base rules don't count, so that junk does not
    move the fences; bin 0 has what is FLOOR or less."""
    good = stats.where(~base_failed())
    bin_of = lambda c: F.when(F.col(c) <= FLOOR, 0).otherwise(F.ceil(F.log(F.col(c) / FLOOR) / np.log(GAMMA))).cast("int")
    bins = [F.struct(F.lit(c).alias("rule"), bin_of(f"__q_{c}").alias("bin")) for c in RULES]
    each = good.select("lang", "source", F.explode(F.array(*bins)).alias("b"))
    return each.groupBy("lang", "source", F.col("b.rule").alias("rule"), F.col("b.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, *group: str) -> DataFrame:
    """group, rule, weight (documents; 0 where the median is in bin 0, which has no scale), mid and spread (logarithms)."""
    bins = sketch.groupBy(*group, "rule", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "rule")
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("all"), F.col("bin")))
    q = ranked.groupBy(*group, "rule").agg(F.max("all").alias("all"), at(1).alias("low"), at(5).alias("mid"), at(9).alias("high"))
    step = float(np.log(GAMMA))
    spread = F.greatest(F.least(F.col("mid") - F.col("low"), F.col("high") - F.col("mid")), F.lit(1)) * step
    return q.select(*group, "rule", F.when(F.col("mid") > 0, F.col("all")).otherwise(0).cast("double").alias("weight"), (F.col("mid") * step + float(np.log(FLOOR))).alias("mid"), spread.alias("spread"))


def _leaning(own: str, on: str) -> Column:
    """The average of a quantile of a group and of the group above it; the own one alone if that has no scale."""
    both = (F.col("weight") * F.col(own) + PRIOR * F.col(on)) / (F.col("weight") + PRIOR)
    return F.when(F.col(on).isNotNull(), both).when(F.col("weight") > 0, F.col(own))


def thresholds(stats: DataFrame) -> DataFrame:
    """lang, source and a fence __t_<rule>_<side> for each rule and side: a row for each language and source of stats that
    has a document which passes the base rules, nulls included. A fence is null where not even all documents have a scale."""
    leaf = saved(sketches(stats), "sketch")
    top = {r["rule"]: r for r in _quantiles(leaf).where("weight > 0").collect()}  # a row for each rule
    over_all = lambda column: F.create_map(*[x for c in RULES for x in (F.lit(c), F.lit(top[c][column] if c in top else None).cast("double"))])[F.col("rule")]
    by_lang = _quantiles(leaf, "lang").withColumn("all_mid", over_all("mid")).withColumn("all_spread", over_all("spread"))
    by_lang = saved(by_lang.select(F.col("lang").alias("__lang"), F.col("rule").alias("__rule"), _leaning("mid", "all_mid").alias("lang_mid"), _leaning("spread", "all_spread").alias("lang_spread")), "languages")
    own = _quantiles(leaf, "lang", "source").join(sized(by_lang), F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("rule") == F.col("__rule")), "left")
    own = own.select("lang", "source", "rule", _leaning("mid", "lang_mid").alias("mid"), F.greatest(_leaning("spread", "lang_spread"), "lang_spread").alias("spread"))
    fence = lambda side: F.exp(F.col("mid") + (REACH if side == "high" else -REACH) * F.col("spread"))
    made = [F.max(F.when(F.col("rule") == c, fence(side))).alias(f"__t_{c}_{side}") for c, sides in RULES.items() for side in sides.split()]
    return saved(own.groupBy("lang", "source").agg(*made), "fences")


def beyond(rule: str, side: str) -> Column:
    """Whether a row with its fences is beyond one by more than the margin of its own count. Rows without words have no ratio."""
    margin = 1 + MARGIN / F.sqrt(F.greatest(F.col(f"__q_n_{rule}"), F.lit(1.0)))
    ratio, fence = F.col(f"__q_{rule}"), F.col(f"__t_{rule}_{side}")
    return F.coalesce(ratio / margin > fence if side == "high" else ratio * margin < fence, F.lit(False))


def judged(stats: DataFrame, fences: DataFrame) -> DataFrame:
    """stats with base_failed and kept. Groups without a fence (all of whose rows fail the base rules) need none."""
    side = sized(fences.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source"))
    joined = stats.join(side, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    out = F.lit(False)
    for c, sides in RULES.items():
        for s in sides.split():
            out = out | beyond(c, s)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~out)


def rules(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, the statistics, base_failed and kept.

    Null and empty texts have no words and fail. Null languages and sources are groups of their own."""
    stats = saved(measured(documents), "stats")
    return judged(stats, thresholds(stats)).select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in [*_STATS, *RULES]], "base_failed", "kept")


def filtered(documents: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with their columns. Statistics are made again beside the text, as that costs
    less than a shuffle of all texts."""
    fences = thresholds(measured(documents))
    docs = set_aside(documents, "text", "lang", "source")
    return put_back(judged(measured(docs, texts=True), fences).where("kept"), docs, documents)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """rules() over all documents: nulls, empty and long texts, repeated rows and empty tables as there."""
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
