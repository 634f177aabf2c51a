"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from timbrel.llm import backoff, conversations, decontamination, jaccard, languages, manifest, neighbours, packing, quality, repeats, resampling, secrets, toxicity

QUERIES = {
    "op1_secret_scans": secrets.query,
    "op2_suffix_array_dedup": repeats.query,
    "op3_quality_rules": quality.query,
    "op4_language_id": languages.query,
    "op5_chat_formatting": conversations.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_best_fit_packing": packing.query,
    "op8_benchmark_decontamination": decontamination.query,
    "op9_lm_scoring": backoff.query,
    "op10_toxicity": toxicity.query,
    "op11_nearest_neighbours": neighbours.query,
    "op12_merkle_manifest": manifest.query,
    "op13_importance_resampling": resampling.query,
}

ORACLES = {
    "op1_secret_scans": secrets.SQL,
    "op6_ngram_jaccard_join": jaccard.SQL,
    "op9_lm_scoring": backoff.SQL,
    "op5_chat_formatting": conversations.SQL,
    "op8_benchmark_decontamination": decontamination.SQL,
    "op11_nearest_neighbours": neighbours.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_importance_resampling": resampling.SQL,
}
