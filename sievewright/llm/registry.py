"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, language, near_dedup, pii, quality_ranker, quality_rules, secrets, sharding, substring_dedup

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language.op2_language_id,
    "op3_secrets": secrets.op3_secrets,
    "op4_sharding": sharding.op4_sharding,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_pii": pii.op6_pii,
    "op7_quality_classifier": quality_ranker.op7_quality_classifier,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}
