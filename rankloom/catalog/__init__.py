"""Queries over the shared test tables, each with the SQL it is checked against."""

from rankloom.catalog.registry import QUERIES, oracle_sql, queries

__all__ = ["QUERIES", "oracle_sql", "queries"]
