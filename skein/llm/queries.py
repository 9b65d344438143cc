"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, html, lm, neardup, packing, pii, quality, rules, spans, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_packing": packing.op7_packing,
    "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
    "op9_warc": warc.op9_warc,
    "op10_substring_dedup": spans.op10_substring_dedup,
}
#: What SQL can express. The other queries are held against brute force in the tests.
SQL: dict[str, str] = {
    "op4_benchmark_decontamination": decontam.SQL,
    "op5_quality_rules": rules.sql(),
    "op8_minhash_near_dedup": neardup.SQL,
    "op9_warc": warc.SQL,
}
