"""All queries of the library and their SQL."""

from __future__ import annotations

from strandbin.plans import bin_queries, coverage_queries, sequence_queries, skew_queries, vector_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (skew_queries, sequence_queries, coverage_queries, bin_queries, vector_queries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
