"""Name -> query and name -> oracle SQL of the evidence operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import build_queries, compare_queries, evidence_queries, extract_queries, graph_queries, list_queries, provider_queries, tree_queries, workspace_queries

BOOKS = [graph_queries.BOOK, evidence_queries.BOOK, compare_queries.BOOK, extract_queries.BOOK, tree_queries.BOOK, list_queries.BOOK, build_queries.BOOK, workspace_queries.BOOK, provider_queries.BOOK]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for b in BOOKS for k, q in b.queries.items()}
ORACLE_SQL: dict[str, str] = {k: q for b in BOOKS for k, q in b.oracle.items()}
