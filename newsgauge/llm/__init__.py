"""Operators for preparing training data: each module holds one operator, its query and its check SQL."""

from newsgauge.llm.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
