"""Queries over the given tables and the SQL they are compared with."""

from checks import exact, ingest, learning, profile, rows, windows  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
