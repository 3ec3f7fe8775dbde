"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from strandloom.llm import decontam, jaccard, lm, manifest, packing, pii, ranked, repeats, secrets, suffixes, token_files, topk, toxicity

QUERIES = {
    "op1_pii": pii.query_op1,
    "op2_toxicity": toxicity.query_op2,
    "op3_substring_dedup": repeats.query_op3,
    "op4_decontamination": decontam.query_op4,
    "op5_secret_scan": secrets.query_op5,
    "op6_best_fit_packing": packing.query_op6,
    "op7_suffix_dedup": suffixes.query_op7,
    "op8_token_files": token_files.query_op8,
    "op9_exact_top_k": topk.query_op9,
    "op10_ngram_jaccard_join": jaccard.query_op10,
    "op11_merkle_manifest": manifest.query_op11,
    "op12_lm_scores": lm.query_op12,
    "op13_ranked_search": ranked.query_op13,
}

ORACLES: dict[str, str] = {
    "op4_decontamination": decontam.SQL_OP4,
    "op9_exact_top_k": topk.SQL_OP9,
    "op11_merkle_manifest": manifest.SQL_OP11,
    "op13_ranked_search": ranked.SQL_OP13,
}
