"""The contract queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat, cohort, lexical, mixing, near_dedup, packing, quality_model, quality_rules, secret_scan, simhash, tokens, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_token_counts": tokens.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_toxicity": toxicity.op6,
    "op7_mixing": mixing.op7,
    "op8_chat_format": chat.op8,
    "op9_nearest": ann.op9,
    "op10_quality_classifier": quality_model.op10,
    "op11_fingerprints": simhash.op11,
    "op12_cohort_retention": cohort.op12,
    "op13_ranked_search": lexical.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_fingerprints": simhash.op11,
    "op12_cohort_retention": cohort.OP12_SQL,
    "op13_ranked_search": lexical.OP13_SQL,
}
