"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from corpusloom.llm import byte_bpe, decontaminate, language_id, line_dedup, merkle_manifest, periodic_runs, piece_bpe, secret_scan, simhash, suffix_tree_lm, token_files, topk_search, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_suffix_tree_lm": suffix_tree_lm.op10_suffix_tree_lm,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_piece_bpe": piece_bpe.op12_piece_bpe,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLE_SQL = {"op2_topk_search": topk_search.SQL, "op7_secret_scan": secret_scan.SQL, "op9_decontaminate": decontaminate.SQL, "op11_periodic_runs": periodic_runs.SQL, "op13_merkle_manifest": merkle_manifest.SQL}
