"""The queries of this subpackage and their SQL, by registered name."""

from __future__ import annotations

from brandlens.llm import ann, byte_bpe, chat_format, collocations, context_tree, exact_topk, filter_audit, html_text, language_id, near_duplicates, source_mix, toxicity, url_filter

QUERIES = {
    "op1_mixing_sources": source_mix.op1_mixing_sources,
    "op2_language_id": language_id.op2_language_id,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_chat_formatting": chat_format.op4_chat_formatting,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_exact_topk": exact_topk.op7_exact_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ngram_jaccard": near_duplicates.op9_ngram_jaccard,
    "op10_ann": ann.op10_ann,
    "op11_lm_scoring": context_tree.op11_lm_scoring,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {
    "op1_mixing_sources": source_mix.OP1_SQL,
    "op4_chat_formatting": chat_format.OP4_SQL,
    "op5_url_filters": url_filter.OP5_SQL,
    "op7_exact_topk": exact_topk.OP7_SQL,
    "op9_ngram_jaccard": near_duplicates.OP9_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
