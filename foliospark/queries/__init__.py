"""Queries of the operators over the driver's tables, each with SQL that computes the same rows independently."""

from __future__ import annotations

from . import granular_queries, page_queries, refined_queries, search_queries, tree_queries

MODULES = (tree_queries, page_queries, granular_queries, refined_queries, search_queries)
QUERIES = {name: run for m in MODULES for name, (run, _) in m.FOUND.items()}
ORACLES = {name: sql for m in MODULES for name, (_, sql) in m.FOUND.items() if sql}
