"""Queries and SQL of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitesmith.llm import containment, conversation_repair, fixity, hard_negatives, kneser_ney, line_spread, mixing, passages, pii, quality_rules, simhash, suffix_dedup, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_line_spread": line_spread.op2_line_spread,
        "op3_passages": passages.op3_passages,
        "op4_quality": kneser_ney.op4_quality,
        "op5_fixity": fixity.op5_fixity,
        "op6_mix": mixing.op6_mix,
        "op7_tokens": token_files.op7_tokens,
        "op8_decontaminate": containment.op8_decontaminate,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_pii": pii.op10_pii,
        "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_spread": line_spread.ORACLE, "op5_fixity": fixity.ORACLE, "op6_mix": mixing.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
