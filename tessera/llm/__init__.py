"""Operators for the preparation of training data; nothing else in the library imports this package."""

from tessera.llm.entries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
