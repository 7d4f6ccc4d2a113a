"""The filter funnel. Each rule is a Column; a row keeps the reason of the first rule it fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.dates import ISO_DAY
from newsgauge.functions.text import bind, matches


def in_date_range(date: Column, date_from: str, date_to: str) -> Column:
    """Inclusive day range. Rows without a proper day are kept: they may well be recent."""
    return F.coalesce(~date.rlike(ISO_DAY) | date.between(date_from, date_to), F.lit(True))


def first_reason(text: Column, rules) -> Column:
    """Reason of the first ``(pattern, reason)`` rule that matches, else NULL."""
    return bind(text, lambda x: reduce(lambda acc, r: acc.when(matches(x, r[0]), r[1]), rules, F))


def own_account(media: Column, pattern: str = v.OWN_ACCOUNT_PATTERN) -> Column:
    return matches(media, pattern)


def noise_reason(title: Column, snippet: Column, rules=v.NOISE_RULES) -> Column:
    return first_reason(F.concat(title, snippet), rules)


def mentions_subject(text: Column, terms: Column, co_occur: Column | None = None) -> Column:
    """The text contains one of the terms, or all words of the co-occurrence list."""

    def hit(whole: Column) -> Column:
        direct = F.exists(terms, lambda x: F.contains(whole, x))
        if co_occur is None:
            return direct
        return direct | F.coalesce(F.forall(co_occur, lambda x: F.contains(whole, x)), F.lit(False))

    return bind(text, hit)


def funnel_reason(
    own_pattern: str = v.OWN_ACCOUNT_PATTERN, rules=v.NOISE_RULES, terms: str = "match_terms",
    co_occur: str = "co_occur",
) -> Column:
    """Reason by which an article leaves the funnel before de-duplication; NULL if it stays."""
    title, snippet = F.col("title"), F.coalesce(F.col("snippet"), F.lit(""))
    text = F.concat(title, snippet)
    return F.coalesce(
        F.when(own_account(F.col("media"), own_pattern), v.REASON_OWN),
        noise_reason(title, snippet, rules),
        F.when(~mentions_subject(text, F.col(terms), F.col(co_occur)), v.REASON_PRECISION),
    )


def split_by_reason(df: DataFrame, reason: str = "filter_reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def only(df: DataFrame, category: str | None = None, source: str | None = None) -> DataFrame:
    """View of a result by tier and/or source."""
    if category is not None:
        df = df.where(F.col("category") == category)
    return df if source is None else df.where(F.col("source") == source)
