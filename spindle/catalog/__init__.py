"""All registered queries and their SQL."""

from spindle.catalog import analytics, ingestion  # noqa: F401  (they register)
from spindle.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
