"""The registered queries of this subpackage."""

from __future__ import annotations

from sigmill.llm import byte_bpe, exact_dedup, fingerprints, html_extract, importance, line_dedup, neighbours, ngram_join, packing, pii, ranked_search, toxicity, url_filters

MODULES = [fingerprints, byte_bpe, neighbours, packing, toxicity, ngram_join, pii, url_filters, line_dedup, html_extract, ranked_search, exact_dedup, importance]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
