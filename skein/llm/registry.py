"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from skein.llm import chat, compactwindows, divergence, fingerprint, jaccard, langid, orderminhash, packing, pieces, pii, quality, whitening, wrappers

QUERIES = {
    "op1_near_duplicates": orderminhash.op1_near_duplicates,
    "op2_repeated_passages": compactwindows.op2_repeated_passages,
    "op3_pii": pii.op3_pii,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_html_extraction": wrappers.op6_html_extraction,
    "op7_packing": packing.op7_packing,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_document_fingerprints": fingerprint.op9_document_fingerprints,
    "op10_language": langid.op10_language,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_ngram_jaccard_join": jaccard.op12_ngram_jaccard_join,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
SQL = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
