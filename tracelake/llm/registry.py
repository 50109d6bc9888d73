"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from tracelake.llm import decontaminate, divergence, fingerprints, lang_id, line_dedup, lm_scoring, mixing, near_dedup, runs, secrets, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_language_id": lang_id.op1_language_id,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {
    "op3_decontamination": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op13_source_divergence": divergence.SQL,
}
