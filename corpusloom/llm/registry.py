"""Queries op1_ to op10_: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, fm_index, licenses, quality, simhash, suffix_levels, toxicity, warc
from .common import table


def tokenizer_path() -> str:
    """The tokenizer file: CORPUSLOOM_TOKENIZER, or the installed public one."""
    if path := os.environ.get("CORPUSLOOM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


def _labelled(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": _documents(licenses.license_scan),
        "op2_simhash_near_dedup": _documents(simhash.simhash_groups),
        "op3_toxicity": _labelled(toxicity.toxicity),
        "op4_substring_dedup": _documents(fm_index.substring_dedup),
        "op5_bpe_encode_decode": _documents(lambda docs: bpe.encode_digests(docs, tokenizer_path())),
        "op6_exact_dedup": _documents(exact_dedup.exact_dedup),
        "op7_suffix_array_dedup": _documents(suffix_levels.suffix_dedup),
        "op8_quality_classifier": _labelled(quality.quality),
        "op9_warc_reassembly": lambda spark, sf_dir: warc.warc_round_trip(table(spark, sf_dir, "pages")),
        "op10_benchmark_decontamination": lambda spark, sf_dir: decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), free_ends=True),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.ORACLE, "op9_warc_reassembly": warc.ORACLE}
