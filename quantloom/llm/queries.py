"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontam, html, langid, licenses, mixing, negatives, phrases, quality, secrets, sharding, simhash, spelling, substrings
from quantloom.llm.common import spread, table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spread(table(spark, sf_dir, name)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": _over("pages", html.extract),
        "op2_license_scan": _over("documents", licenses.scan_licenses),
        "op3_source_mixing": _over("documents", mixing.mixture),
        "op4_sharding": _over("documents", sharding.placement),
        "op5_substring_dedup": _over("documents", substrings.deduplicate),
        "op6_quality_rules": _over("documents", quality.quality),
        "op7_simhash_dedup": _over("documents", simhash.near_duplicates),
        "op8_decontamination": lambda spark, sf_dir: decontam.decontaminate(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")),
        "op9_language_id": _over("documents", langid.identify),
        "op10_secret_scan": _over("documents", secrets.scan_secrets),
        "op11_phrase_fingerprints": _over("documents", phrases.neighbours),
        "op12_hard_negatives": _over("embeddings", negatives.mined),
        "op13_spelling_variants": _over("documents", spelling.variants),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the operator; tests hold the rest against brute force."""
    return {
        "op3_source_mixing": mixing.oracle_sql(),
        "op4_sharding": sharding.oracle_sql(),
        "op6_quality_rules": quality.oracle_sql(),
        "op12_hard_negatives": negatives.oracle_sql(),
        "op13_spelling_variants": spelling.oracle_sql(),
    }
