"""A whole request over a landed article table: keywords, queries, search, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgauge.operators import dedup, keywords as kw
from newsgauge.operators.position import with_position
from newsgauge.plans.coverage import Dimensions, Report, Settings, coverage_report
from newsgauge.plans.search import search_places
from newsgauge.session import cut


def requested_articles(articles: DataFrame, keywords: DataFrame, subjects: DataFrame,
                       max_per_query: int | None = None) -> DataFrame:
    """The articles that the generated queries of each keyword find, each once per keyword: all of them, or of each query
    the ``max_per_query`` newest.

    ``articles`` needs a unique ``ord`` and the article columns; ``ord`` of the result is new: keyword by
    keyword, query by query, newest first.
    """
    planned = kw.plan_searches(kw.resolve_keywords(kw.clean_keywords(keywords), subjects))
    queries = kw.query_rows(planned)
    articles = articles.drop(*[c for c in queries.columns if c in articles.columns])
    hits = search_places(articles, queries, max_per_query)
    once = dedup.keep_first(hits, [F.col("keyword"), F.col("ord")], [F.col("query_rank"), F.col("pos")])
    once = cut(once.select("keyword", "keyword_rank", "query_rank", "pos", "_row", F.col("ord").alias("landed_ord")))
    order = [F.col(c) for c in ("keyword_rank", "query_rank", "pos", "landed_ord")]
    once = with_position(once, order, name="ord").select("keyword", "landed_ord", "ord", F.col("_row").alias("_found"))
    # the texts come last and are dealt once, by the hash alone; of equal rows of one id one is found
    rows = articles.withColumn("_row", F.xxhash64(*articles.columns)).withColumnRenamed("ord", "_ord")
    same = F.coalesce(F.col("_ord") == F.col("landed_ord"), F.col("_ord").isNull() & F.col("landed_ord").isNull())
    rows = rows.join(once, (F.col("_row") == F.col("_found")) & same)
    rows = dedup.keep_first(rows, [F.col("_found"), F.col("keyword"), F.col("landed_ord")], [F.col("ord")])
    return rows.select(*[F.col("landed_ord") if c == "ord" else F.col(c) for c in articles.columns], "keyword", "ord")


def request_report(articles: DataFrame, keywords: DataFrame, dims: Dimensions, settings: Settings,
                   max_per_query: int | None = None) -> Report:
    """Search a landed article table for the keywords and report their coverage."""
    found = requested_articles(articles, keywords, dims.subjects, max_per_query)
    return coverage_report(found, keywords, dims, settings)
