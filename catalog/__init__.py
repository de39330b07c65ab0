"""Registered queries with their oracle SQL, one module per operator group."""

from catalog import (  # noqa: F401
    cleaning_queries,
    model_queries,
    profile_queries,
    project_queries,
    rate_queries,
    source_queries,
    validation_queries,
)
from catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
