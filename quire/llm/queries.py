"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from quire.llm import alignment, chat, exact_dedup, fingerprints, html_text, importance, licenses, mixing, packing, pseudonyms, quality, simhash, url_rules

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_packing": packing.op3_packing,
    "op4_url_filters": url_rules.op4_url_filters,
    "op5_pii": pseudonyms.op5_pii,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_document_fingerprints": fingerprints.op11_document_fingerprints,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_quality_rules": quality.ORACLE_SQL,
    "op4_url_filters": url_rules.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_chat_formatting": chat.ORACLE_SQL,
    "op12_importance_resampling": importance.ORACLE_SQL,
}
