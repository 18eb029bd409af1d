"""Operators for preparing training text; nothing else in the library imports this subpackage."""

from residua.llm import queries
from residua.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "queries"]
