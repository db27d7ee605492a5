"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusgrid.llm import chat, conversation_trie, exact_dedup, html_extract, licenses, mixing, near_dedup, packing, quality, run_detection, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_near_dedup": near_dedup.query,
    "op3_extract_html": html_extract.query,
    "op4_format_chats": chat.query,
    "op5_pack_sequences": packing.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_scan_licenses": licenses.query,
    "op8_quality_rules": quality.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_token_files": token_files.query,
    "op11_url_filter": url_filter.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_run_detection": run_detection.query,
}
ORACLE = {"op6_exact_dedup": exact_dedup.ORACLE}
