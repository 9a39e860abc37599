"""Registered queries of the core and their SQL."""

from graphloom.queries import clean_queries, graph_queries, orphan_queries, series_queries, text_queries
from graphloom.queries.graph_queries import flagship
from graphloom.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "clean_queries", "flagship", "graph_queries", "orphan_queries", "series_queries", "text_queries"]
