"""The registered queries of this subpackage and their SQL."""

from cobaltmill.llm import (
    audit, bpe, fingerprint, interpolation, jaccard, langid, lines, mixing, quality, ranking, topk, urls, warc,
)

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_line_dedup": lines.query,
    "op3_bpe_round_trip": bpe.query,
    "op4_ngram_jaccard_join": jaccard.query,
    "op5_exact_top_k": topk.query,
    "op6_warc_revisits": warc.query,
    "op7_url_filter": urls.query,
    "op8_language_id": langid.query,
    "op9_quality_co_training": quality.query,
    "op10_fingerprints": fingerprint.query,
    "op11_lm_scoring": interpolation.query,
    "op12_lexical_search": ranking.query,
    "op13_filter_audit": audit.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op2_line_dedup": lines.SQL,
    "op4_ngram_jaccard_join": jaccard.SQL,
    "op5_exact_top_k": topk.SQL,
    "op6_warc_revisits": warc.SQL,
    "op12_lexical_search": ranking.SQL,
    "op13_filter_audit": audit.SQL,
}
