"""All queries of the library and the SQL that each is held against."""

from __future__ import annotations

from . import cascade_queries, document_queries, evidence_queries, feature_queries, glossary_queries, layout_queries, metric_queries, outcome_queries, pool_queries, record_queries, review_queries, rule_queries, scan_queries, term_queries

MODULES = (rule_queries, term_queries, metric_queries, layout_queries, review_queries, outcome_queries, cascade_queries, record_queries, scan_queries, evidence_queries, document_queries, feature_queries, glossary_queries, pool_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
