"""First-wins de-duplication and the near-duplicate title merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge import values as v
from newsgauge.functions.text import blank_to_null, trim_ws
from newsgauge.functions.urls import canonical_url, dedup_url
from newsgauge.operators.position import BROADCAST_ROWS
from newsgauge.operators.similar import FOLD_ROWS, merged_places
from newsgauge.session import cut


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row per key. The rank limit is applied before the shuffle, so a hot key sends one
    row per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: list[Column], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows per key, optionally with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name or "_rn", F.row_number().over(w)).where(F.col(name or "_rn") <= n)
    return ranked if name else ranked.drop("_rn")


def flag_first(df: DataFrame, keys: list[Column], order: list[Column], row_id: str, name: str = "is_first",
               among: Column | None = None) -> DataFrame:
    """Mark the first row per key, keeping all rows; ``row_id`` is unique and settles ties. With ``among`` only such rows compete.

    Two phases. Only key, order and row id are shuffled to find the winners, and of a hot key each map task
    sends one row. The winners are then joined by row id, of which no two rows share one, so no key
    decides how the wide rows are dealt; few winners are broadcast.
    """
    winners = keep_first(df if among is None else df.where(among), keys, [*order, F.col(row_id)]).select(F.col(row_id).alias("_winner"))
    return df.join(winners, F.col(row_id) == F.col("_winner"), "left").select(*df.columns, F.col("_winner").isNotNull().alias(name))


# --- exact keys --------------------------------------------------------------------------------------

def by_url(df: DataFrame, order: str = "ord", within: list[str] | None = None) -> DataFrame:
    """One row per canonical URL (and ``within`` columns). The same story on another site stays."""
    keys = [F.col(c) for c in within or []]
    return keep_first(df, [*keys, canonical_url(F.col("url"))], [F.col(order)])


def dropped(df: DataFrame, kept: DataFrame, column: str = "url") -> DataFrame:
    """Rows that a de-duplication lost: those whose ``column`` no kept row has."""
    return df.join(kept.select(column).distinct(), column, "left_anti").select(*df.columns)


def by_url_or_title(df: DataFrame, order: str = "ord", within: list[str] | None = None, n: int | None = None) -> DataFrame:
    """One row per link, or title where there is no link; of either the first ``n`` characters if given."""
    key = url_prefix(F.coalesce(blank_to_null(F.col("url")), F.col("title")), n)
    return keep_first(df, [*[F.col(c) for c in within or []], key], [F.col(order)])


def url_prefix(url: Column, n: int | None = None) -> Column:
    """The whole link, or its first ``n`` characters."""
    return url if n is None else F.substring(url, 1, n)


def by_url_prefix(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """One row per link, or link prefix, over all subjects; the first subject owns the row."""
    return keep_first(df, [url_prefix(F.col("url"), n)], order)


def by_link_then_title(df: DataFrame, order: str = "ord", within: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Account articles: link (its first ``n`` characters if given) first, then the exact trimmed title among the survivors."""
    keys = [F.col(c) for c in within or []]
    once = keep_first(df, [*keys, url_prefix(F.col("url"), n)], [F.col(order)])
    return keep_first(once, [*keys, trim_ws(F.col("title"))], [F.col(order)])


# --- near-duplicate titles -------------------------------------------------------------------------

def merge_similar(df: DataFrame, group: list[str], order: list[str], threshold: float = v.TITLE_SIMILARITY,
                  limit: int | None = None, place: str = "place", link_chars: int | None = None,
                  fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Merge near-duplicate titles within each group, in order; lists may have any length.

    A row is skipped if its URL key was seen at a leader. Else it meets the first leader with a similar
    title: the one with the longer snippet stays, in the leader's place and under the leader's URL key. A
    row that meets no leader becomes one. Returns the leaders' rows and their ``place`` in the merged
    list, the first ``limit`` of each if given. URL keys are compared whole, or by ``link_chars`` characters.

    Only order, key, characters and snippet length take part; the other columns are joined to the result.
    ``order`` should tell all rows of a group apart: ties are settled by a hash of the row.
    """
    rows = cut(df.withColumn("_id", F.struct(F.xxhash64(*df.columns), F.monotonically_increasing_id())))
    narrow = rows.select(*dict.fromkeys([*group, *order]), F.col("_id").alias("id"), dedup_url(F.col("url"), link_chars).alias("key"),
                         F.lower("title").alias("title"), F.length("snippet").alias("size"))
    led = merged_places(narrow, group, order, threshold, fold_rows)
    if limit is not None:
        led = led.where(F.col("place") < limit)
    led = cut(led.select(F.col("id").alias("_id"), F.col("place").alias("_place")))
    if led.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        led = F.broadcast(led)
    payload = [c for c in df.columns if c not in group]
    return rows.join(led, "_id").select(
        *group, F.col("_place").alias(place), *payload)


def merge_searches(df: DataFrame, max_per_query: int | None = None, max_total: int | None = None,
                   threshold: float = v.TITLE_SIMILARITY, link_chars: int | None = None) -> DataFrame:
    """Result lists of several engines and queries to one list per keyword.

    Merges per query, then over the queries of a keyword. Takes whole lists, or at most ``max_per_query`` rows of each engine
    and query, and returns whole lists, or the first ``max_total`` rows.
    Needs ``keyword, query_rank, engine_rank, page_no, pos`` and the article columns; with ``payload``,
    which names the fetch of a page, rows of one page number are ordered by it.
    """
    fetch = ["payload"] if "payload" in df.columns else []
    order = ["engine_rank", "page_no", *fetch, "pos"]
    if max_per_query is not None:
        df = top_n(df, [F.col("keyword"), F.col("query_rank"), F.col("engine_rank")], [F.col(c) for c in order[1:]], max_per_query)
    per_query = merge_similar(df, ["keyword", "query_rank"], order, threshold, place="query_place", link_chars=link_chars)
    merged = merge_similar(per_query, ["keyword"], ["query_rank", "query_place"], threshold, max_total, link_chars=link_chars)
    return merged.drop("query_place", *fetch)
