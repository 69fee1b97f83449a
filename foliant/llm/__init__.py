"""Operators for preparing training data; nothing else in the library imports this subpackage."""

from foliant.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
