"""Named queries over the given tables, each with the SQL another engine can check it by."""

from newsgauge.catalogue.registry import ORACLE, QUERIES
from newsgauge.catalogue import classifying, counting, deduping, filtering, parsing, reporting, scalars, scoring, searching  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
