"""Title similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def title_chars(title: Column) -> Column:
    """Distinct lower-case characters of a title."""
    return F.array_distinct(F.split(F.lower(title), ""))


def chars_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared distinct characters over the larger character set; 1 for equal titles."""
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).otherwise(
        chars_similarity(title_chars(a), title_chars(b))
    )
