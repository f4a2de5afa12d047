"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, language_id, lexical_search, license_scan, minhash_dedup, ngram_join, quality, sentencepieces, substring_dedup, token_alignment, topk_search, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_html_text": html_text.op5_html_text,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_sentencepieces": sentencepieces.op9_sentencepieces,
    "op10_quality": quality.op10_quality,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

SQL = {
    "op2_topk_search": topk_search.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_license_scan": license_scan.OP4_SQL,
    "op5_html_text": html_text.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_minhash_dedup": minhash_dedup.OP7_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op12_ngram_join": ngram_join.OP12_SQL,
}
