"""All queries of the library but those of the corpus subpackage, by name, and their SQL."""

from __future__ import annotations

from . import analysis_queries, gate_queries, record_queries, review_queries, term_queries, text_queries

_PARTS = (gate_queries, term_queries, text_queries, review_queries, analysis_queries, record_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
