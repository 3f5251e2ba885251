"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from . import bpe, jaccard, language, lines, mixing, neardup, quality, tokenfile, topk, urls

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources, bpe.op2_byte_bpe, neardup.op3_embedding_near_dedup, topk.op4_exact_top_k, jaccard.op5_jaccard_join,
        tokenfile.op6_token_files, lines.op7_line_dedup, language.op8_language_id, urls.op9_url_filters, quality.op10_quality_classifier,
    )
}

ORACLES = {
    "op3_embedding_near_dedup": neardup.OP3_SQL, "op4_exact_top_k": topk.OP4_SQL, "op5_jaccard_join": jaccard.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL, "op9_url_filters": urls.OP9_SQL,
}
