"""Every query of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from tracewell.llm import queries_dedup, queries_media, queries_models, queries_tokens, queries_vectors

QUERIES = {
    "op1_html_extraction": queries_media.op1_html_extraction,
    "op10_media_columns": queries_media.op10_media_columns,
    "op5_quality_classifier": queries_models.op5_quality_classifier,
    "op6_language_id": queries_models.op6_language_id,
    "op2_exact_topk_search": queries_vectors.op2_exact_topk_search,
    "op3_ngram_jaccard_join": queries_dedup.op3_ngram_jaccard_join,
    "op4_bpe_codec": queries_tokens.op4_bpe_codec,
    "op7_token_counts": queries_tokens.op7_token_counts,
    "op8_best_fit_packing": queries_tokens.op8_best_fit_packing,
    "op9_substring_dedup": queries_dedup.op9_substring_dedup,
}
ORACLE_SQL = {
    "op2_exact_topk_search": queries_vectors.OP2_SQL,
    "op3_ngram_jaccard_join": queries_dedup.OP3_SQL,
    "op9_substring_dedup": queries_dedup.OP9_SQL,
}
