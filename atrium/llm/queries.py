"""The training-data queries and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline

from . import chat, codebooks, divergence, fingerprints, jaccard, language, lines, mixing, multi_index, pages, pivots, segmentations, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_warc_transactions": warc.op1_warc_transactions,
    "op2_inverted_multi_index": multi_index.op2_inverted_multi_index,
    "op3_gumbel_segmentations": segmentations.op3_gumbel_segmentations,
    "op4_fingerprint_dedup": fingerprints.op4_fingerprint_dedup,
    "op5_suffix_array_lines": lines.op5_suffix_array_lines,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_pivot_permutation": pivots.op7_pivot_permutation,
    "op8_template_extraction": pages.op8_template_extraction,
    "op9_low_discrepancy_mix": mixing.op9_low_discrepancy_mix,
    "op10_language_id": language.op10_language_id,
    "op11_vector_codes": codebooks.op11_vector_codes,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_chat_format": chat.op13_chat_format,
}

ORACLES = {
    "op1_warc_transactions": warc.ORACLE,
    "op4_fingerprint_dedup": fingerprints.ORACLE,
    "op5_suffix_array_lines": lines.ORACLE,
    "op6_ngram_jaccard_join": jaccard.ORACLE,
    "op7_pivot_permutation": pivots.ORACLE,
    "op9_low_discrepancy_mix": mixing.ORACLE,
    "op11_vector_codes": codebooks.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_chat_format": chat.ORACLE,
}
