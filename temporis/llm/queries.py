"""The queries of this package and the SQL that some of them equal."""

from __future__ import annotations

from temporis.llm import alignment, ann, chat, codes, jaccard, lattice, mixing, packing, quality, secrets, suffixes, topk, toxicity

QUERIES = {
    "op1_ann_search": ann.op1_ann_search,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_alignment": alignment.op11_alignment,
    "op12_lm_scoring": lattice.op12_lm_scoring,
    "op13_vector_codes": codes.op13_vector_codes,
}
ORACLES = {"op3_chat_format": chat.ORACLE, "op8_exact_topk": topk.ORACLE, "op13_vector_codes": codes.ORACLE}
