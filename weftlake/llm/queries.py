"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from . import exact_dedup, hnsw, html_wrapper, language_id, licenses, mixing, ngram_join, packing, pii, sharding

_OPERATORS = {
    "op1_sharding": sharding,
    "op2_exact_dedup": exact_dedup,
    "op3_language_id": language_id,
    "op4_html_wrapper": html_wrapper,
    "op5_mixing": mixing,
    "op6_ngram_join": ngram_join,
    "op7_packing": packing,
    "op8_hnsw": hnsw,
    "op9_licenses": licenses,
    "op10_pii": pii,
}

QUERIES = {name: m.query for name, m in _OPERATORS.items()}
SQL = {name: m.SQL for name, m in _OPERATORS.items() if getattr(m, "SQL", None)}
