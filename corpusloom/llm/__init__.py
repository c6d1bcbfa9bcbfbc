"""Operators of a training-data pipeline; nothing else in the library imports them."""

from corpusloom.llm.oracle import oracle_sql
from corpusloom.llm.queries import queries

__all__ = ["oracle_sql", "queries"]
