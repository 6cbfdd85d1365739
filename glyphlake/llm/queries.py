"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import bpe, fingerprints, language_model, licenses, neardup, packing, quality, substrings, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bpe.op1_bpe,
        quality.op2_quality_rules,
        licenses.op3_license_scan,
        fingerprints.op4_fingerprints,
        neardup.op5_minhash_dedup,
        toxicity.op6_toxicity,
        token_counts.op7_token_counts,
        substrings.op8_suffix_dedup,
        packing.op9_packing,
        language_model.op10_language_model,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality.OP2_SQL, "op5_minhash_dedup": neardup.OP5_SQL, "op8_suffix_dedup": substrings.OP8_SQL}
