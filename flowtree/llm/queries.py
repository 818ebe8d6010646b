"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, licenses, mixing, neardup, quality, tokencount, toxicity, urlfilter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_chat": chat.op3_chat,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_licenses": licenses.op8_licenses,
    "op9_near_dedup": neardup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    # on fixtures, of what the test tables don't hold
    "chat_tool_calls": chat.chat_tool_calls,
    "url_redirects": urlfilter.url_redirects,
}
ORACLE = {
    "op3_chat": chat.sql(),
    "op6_mixing": mixing.sql(),
    "op7_url_filter": urlfilter.sql(),
    "op8_licenses": licenses.sql(),
    "chat_tool_calls": chat.tool_calls_sql(),
    "url_redirects": urlfilter.redirects_sql(),
}
