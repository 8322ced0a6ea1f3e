"""The queries of this package and, where SQL can express them, the SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, license, linededup, mixing, qrules, quality, secrets, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_near_duplicates": simhash.op2_near_duplicates,
    "op3_quality": quality.op3_quality,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_licenses": license.op5_licenses,
    "op6_language_id": langid.op6_language_id,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality_rules": qrules.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL: dict[str, str] = {
    "op1_decontaminate": decontam.OP1_SQL,
    "op4_line_dedup": linededup.OP4_SQL,
}
