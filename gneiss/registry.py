"""All registered queries with the SQL that they are held against."""

from __future__ import annotations

from .plans import app_queries, appendix_queries, citation_queries, compound_queries, evaluation_queries, evidence_queries, expansion_queries, fusion_queries, graph_queries, guard_queries, reference_queries, retrieval_queries, rule_queries, structure_queries, text_queries, unit_queries

_MODULES = (text_queries, graph_queries, app_queries, evaluation_queries, retrieval_queries, structure_queries, citation_queries, reference_queries, unit_queries, expansion_queries, rule_queries, guard_queries, evidence_queries, compound_queries, fusion_queries, appendix_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
