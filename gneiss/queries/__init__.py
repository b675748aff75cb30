"""Registered queries over the reference's operators and their DuckDB equivalents."""

from gneiss.queries import changes, clusters, evidence, facts, history, mapping, origins, readiness, settings, similar  # noqa: F401  they register on import
from gneiss.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
