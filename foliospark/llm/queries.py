"""The queries that __spark_entry__.py registers for this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe, conversation_repair, fingerprint, jaccard_join, line_dedup, lm, mixing, near_dup, preference, substring_dedup, toxicity

_MODULES = {"op1_repeated_passages": substring_dedup, "op2_byte_bpe": bpe, "op3_line_dedup": line_dedup, "op4_fingerprints": fingerprint, "op5_mix_sources": mixing, "op6_preference_format": preference, "op7_nearest_vectors": ann, "op8_lm_scores": lm, "op9_near_duplicates": near_dup, "op10_toxicity": toxicity, "op11_conversation_repair": conversation_repair, "op12_token_alignment": alignment, "op13_jaccard_join": jaccard_join}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for module in _MODULES.values() for k, v in getattr(module, "ORACLE_SQL", {}).items()}
