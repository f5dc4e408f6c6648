"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from grafonda.llm import fingerprints, html_blocks, langid, licenses, near_dedup, packing, quality, secrets, sentencepiece_codec, token_counts

QUERIES = {
    "op1_html_blocks": html_blocks.query,
    "op2_near_dedup": near_dedup.query,
    "op3_quality": quality.query,
    "op4_packing": packing.query,
    "op5_langid": langid.query,
    "op6_licenses": licenses.query,
    "op7_sentencepiece": sentencepiece_codec.query,
    "op8_secrets": secrets.query,
    "op9_token_counts": token_counts.query,
    "op10_fingerprints": fingerprints.query,
}

ORACLE_SQL = {
    "op3_quality": quality.ORACLE_SQL,
    "op6_licenses": licenses.ORACLE_SQL,
}
