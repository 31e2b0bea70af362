"""Registered queries (each reads the driver's tables) and their SQL oracles."""

from skywatch.registry.oracle import oracle_sql
from skywatch.registry.queries import QUERIES, flagship

__all__ = ["QUERIES", "flagship", "oracle_sql"]
