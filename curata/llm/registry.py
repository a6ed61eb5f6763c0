"""The subpackage's queries, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from curata.llm import bpe, decontaminate, jaccard, language, lexical, licenses, lm, quality, secrets, token_counts, topk, urls, whitening

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_language_id": language.op2_language_id,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_topk": topk.op5_topk,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_url_filter": urls.op7_url_filter,
    "op8_lm_score": lm.op8_lm_score,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_quality": quality.op10_quality,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_license_scan": licenses.op13_license_scan,
}
ORACLES: dict[str, str] = {"op5_topk": topk.ORACLE, "op11_lexical_search": lexical.ORACLE}
