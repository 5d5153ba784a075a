"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import attention_quality, bpe, bwt_dedup, chat, divergence_rules, hard_negatives, mixing, near_dedup, periodic_runs, ppm, sketch_dedup, tree_bpe, trie_dedup

_MODULES = {
    "op1_attention_quality": attention_quality,
    "op2_patricia_exact_dedup": trie_dedup,
    "op3_ppm_lm_scoring": ppm,
    "op4_count_min_substring_dedup": sketch_dedup,
    "op5_relational_chat_format": chat,
    "op6_duckdb_byte_bpe": bpe,
    "op7_divergence_quality_rules": divergence_rules,
    "op8_hypergeometric_mixing": mixing,
    "op9_minhash_near_dedup": near_dedup,
    "op10_bwt_substring_dedup": bwt_dedup,
    "op11_tree_bpe": tree_bpe,
    "op12_periodic_runs": periodic_runs,
    "op13_rns_hard_negatives": hard_negatives,
}
QUERIES = {name: getattr(module, name) for name, module in _MODULES.items()}
SQL = {name: module.SQL for name, module in _MODULES.items() if module.SQL is not None}
