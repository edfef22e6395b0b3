"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from parcelflow.llm import langid, licenses, mixing, neardup, packing, quality, search, substring, urlfilter, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_minhash_neardup": neardup.op2_minhash_neardup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_warc": warc.op4_warc,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_pack_sequences": packing.op6_pack_sequences,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_bm25_topk": search.op8_bm25_topk,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_language_id": langid.op10_language_id,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_minhash_neardup": neardup.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op4_warc": warc.ORACLE,
    "op5_url_filter": urlfilter.oracle(),
    "op7_quality_rules": quality.ORACLE,
    "op8_bm25_topk": search.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
    "op10_language_id": langid.ORACLE,
}
