"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from cohortmart.llm import chat, decontaminate, jaccard_join, language_id, mixing, periodic_runs, pii, pivot_index, prefix_trie, quality, secrets, token_orc, toxicity

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_chat_format": chat.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_pii": pii.query,
    "op5_mix_sources": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_pivot_index": pivot_index.query,
    "op8_token_orc": token_orc.query,
    "op9_secrets": secrets.query,
    "op10_decontaminate": decontaminate.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_quality": quality.query,
}

ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op7_pivot_index": pivot_index.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_periodic_runs": periodic_runs.ORACLE,
}
