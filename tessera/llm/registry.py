"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ego_join, importance, langid, line_dedup, lsh_search, merkle, ngram_join, oracle, packing, pii, quality, sentencepiece_nbest, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_sentencepiece_nbest": sentencepiece_nbest.op6_sentencepiece_nbest,
        "op7_language_id": langid.op7_language_id,
        "op8_epsilon_grid_join": ego_join.op8_epsilon_grid_join,
        "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
        "op10_multiprobe_lsh": lsh_search.op10_multiprobe_lsh,
        "op11_quality_rules": quality.op11_quality_rules,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": oracle.OP1,
        "op2_ngram_jaccard_join": oracle.OP2,
        "op5_substring_dedup": oracle.OP5,
        "op8_epsilon_grid_join": oracle.OP8,
        "op12_merkle_manifest": oracle.OP12,
        "op13_importance_resampling": oracle.OP13,
    }
