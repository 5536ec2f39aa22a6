"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import cover_tree, decontaminate, html_template, mixing, near_dup, pii, quality, secrets, url_filter, warc

QUERIES = {
    "op1_warc_chunked": warc.op1_warc_chunked,
    "op2_url_ratio": url_filter.op2_url_ratio,
    "op3_cover_tree": cover_tree.op3_cover_tree,
    "op4_benchmark_leaks": decontaminate.op4_benchmark_leaks,
    "op5_quality_kneser_ney": quality.op5_quality_kneser_ney,
    "op6_pii_disclosure": pii.op6_pii_disclosure,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_secret_ledger": secrets.op8_secret_ledger,
    "op9_main_text": html_template.op9_main_text,
    "op10_source_mixing": mixing.op10_source_mixing,
}

ORACLES = {
    "op1_warc_chunked": warc.ORACLE,
    "op3_cover_tree": cover_tree.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
