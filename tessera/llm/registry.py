"""Queries of the training-data operators and their oracles."""

from . import ann, decontaminate, language_model, mixing, pii, secret_scan, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ann": ann.op2_ann,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_language_model": language_model.op7_language_model,
    "op8_mix": mixing.op8_mix,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {
    "op8_mix": mixing.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
