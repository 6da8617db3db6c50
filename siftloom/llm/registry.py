"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import q_bpe, q_fill_middle, q_hard_negatives, q_html_text, q_line_dedup, q_ngram_join, q_packing, q_quality_classifier, q_quality_rules, q_secret_scans, q_url_filters, q_vector_dedup, q_warc

_MODULES = (q_line_dedup, q_warc, q_bpe, q_ngram_join, q_url_filters, q_secret_scans, q_quality_classifier, q_quality_rules, q_packing, q_vector_dedup, q_hard_negatives, q_fill_middle, q_html_text)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
