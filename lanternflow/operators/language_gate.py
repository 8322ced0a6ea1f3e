"""Checks of memo text: a gate on how political exposure is described, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Adverse terms, disqualifying patterns, the context that they count in, the required framing.
ADVERSE = "adverse criminal corrupt corruption launder laundering illicit fraud fraudulent wrongdoing guilty perpetrator offender suspect".split()
DISQUALIFYING = [r"\b(must|should|will)\s+(be\s+)?(declin|reject|refus|exit|terminat|offboard|close)", r"\bdo\s+not\s+onboard\b", r"\bnot\s+(?:be\s+)?acceptab\w*\b", r"\bprohibited\s+(?:customer|relationship)\b", r"\bblacklist"]
CONTEXT = r"(?i)\b(pep|politically\s+exposed|senior\s+(?:political|government)\s+official|minister|governor|state\s+official)\b"
FRAMING = (
    "A politically exposed person match is a category that requires enhanced due diligence under FATF "
    "Recommendation 12 - senior management approval, source of wealth and source of funds, and enhanced "
    "ongoing monitoring. It is not an adverse finding and it is not a reason to decline the relationship."
)
CITATION = r"\[(?:cite|reg|stmt):([^\]]+)\]"


def _unnegated(term: str) -> str:
    """The term without a negation in the 40 characters before it, as one expression with a bounded look-behind."""
    return rf"(?<!\b(?:not|never|neither|no)\b[^.]{{0,30}})\b{term}\w*\b"


def language_check(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with pep_mentioned, n_violations, framing_present, passed. One violation per sentence and term or pattern."""
    sentences = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+"), F.trim), lambda s: s.rlike(CONTEXT))
    hits = lambda s: sum((F.lower(s).rlike(p).cast("int") for p in [*map(_unnegated, ADVERSE), *DISQUALIFYING]), F.lit(0))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    framing = low.contains("enhanced due diligence") & (low.contains("not an adverse finding") | low.contains("not itself an adverse") | low.contains("does not"))
    t = texts.withColumn("__s", sentences)
    t = t.withColumn("pep_mentioned", F.size("__s") > 0).withColumn("n_violations", F.aggregate("__s", F.lit(0), lambda a, s: a + hits(s)).cast("bigint"))
    t = t.withColumn("framing_present", F.col("pep_mentioned") & framing)
    return t.withColumn("passed", ~F.col("pep_mentioned") | ((F.col("n_violations") == 0) & F.col("framing_present"))).drop("__s")


def gate_counts(checked: DataFrame) -> DataFrame:
    """One row over texts with a verdict: documents, mentioning (the subject at all), passing of these, rate, violations."""
    said = F.col("pep_mentioned")
    c = checked.agg(F.count(F.lit(1)).alias("documents"), F.count_if(said).alias("mentioning"), F.count_if(said & F.col("passed")).alias("passing"), F.coalesce(F.sum("n_violations"), F.lit(0)).alias("violations"))
    return c.withColumn("rate", F.when(F.col("mentioning") > 0, F.col("passing") / F.col("mentioning")))


def enforced(text: Column, is_pep: Column, framing_present: Column) -> Column:
    """text with the framing after it where it is due and missing; violations are never removed."""
    return F.when(is_pep & ~framing_present, F.concat(F.rtrim(text), F.lit("\n\n" + FRAMING))).otherwise(text)


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def verify_citations(memos: DataFrame, valid: DataFrame, memo: str = "memo_id") -> DataFrame:
    """memo, cited, unresolved, rate: valid: id. Without a citation nothing is unresolved and the rate is 1."""
    each = memos.select(F.col(memo).alias("memo"), F.explode_outer(citations(F.col("text"))).alias("id"))
    j = each.join(valid.select("id").distinct().withColumn("ok", F.lit(1)), "id", "left")
    c = j.groupBy("memo").agg(F.count("id").alias("cited"), F.count_if(F.col("id").isNotNull() & F.col("ok").isNull()).alias("unresolved"))
    return c.withColumn("rate", F.when(F.col("cited") > 0, 1 - F.col("unresolved") / F.col("cited")).otherwise(1.0))


def uncited_claims(text: Column) -> Column:
    """Sentences of eight words or more, not headings, lists or tables, without a citation."""
    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(sentences, lambda s: (F.size(F.split(F.trim(s), r"\s+")) >= 8) & ~F.trim(s).rlike(r"^[#*|-]") & ~s.rlike(CITATION))
