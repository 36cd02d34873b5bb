"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, decontaminate, licenses, mixing, near_dup, quality, sharding, suffix_dedup, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.query,
        "op2_licenses": licenses.query,
        "op3_chunk_dedup": chunk_dedup.query,
        "op4_mixing": mixing.query,
        "op5_token_files": token_files.query,
        "op6_token_counts": token_counts.query,
        "op7_near_dup": near_dup.query,
        "op8_decontaminate": decontaminate.query,
        "op9_quality": quality.query,
        "op10_suffix_dedup": suffix_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_near_dup": near_dup.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE}
