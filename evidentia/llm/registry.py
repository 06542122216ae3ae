"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from evidentia.llm import alignment, byte_bpe, chat_format, maxent_lm, mixing, pairwise_quality, pivot_index, pu_toxicity, quality_rules, simhash, substring_dedup, token_store, turn_repair

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_token_store": token_store.op4_token_store,
    "op5_pivot_index": pivot_index.op5_pivot_index,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_maxent_lm": maxent_lm.op7_maxent_lm,
    "op8_pairwise_quality": pairwise_quality.op8_pairwise_quality,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_pu_toxicity": pu_toxicity.op10_pu_toxicity,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_pivot_index": pivot_index.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_chat_format": chat_format.ORACLE,
}
