"""Report-quality score."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge.catalogue import checks as k
from newsgauge.catalogue.registry import query
from newsgauge.catalogue.views import ARTICLES_SQL, articles
from newsgauge.functions.text import score_band
from newsgauge.operators import score

_BAND = "CASE WHEN score >= 30 THEN 'high' WHEN score >= 15 THEN 'ok' ELSE 'low' END"


@query("quality_score", f"SELECT ord, score, detail, {_BAND} AS band FROM {k.score(ARTICLES_SQL)}")
def quality_score(spark, sf):
    return score.with_score(articles(spark, sf)).select(
        "ord", "score", F.array_join("score_detail", "; ").alias("detail"), score_band(F.col("score")).alias("band")
    )


@query("score_parts", f"""SELECT ord, CASE WHEN chars BETWEEN 10 AND 29 THEN 10 WHEN chars BETWEEN 5 AND 39 THEN 5 ELSE 0 END AS length_points,
  CASE WHEN events >= 2 THEN 30 WHEN events = 1 THEN 20 ELSE 0 END AS event_points, CASE WHEN progress >= 2 THEN 10 ELSE 0 END AS progress_points,
  CASE WHEN regexp_matches(title, '[-—:：]') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(title, '[！!]') THEN 2 ELSE 0 END AS structure_points,
  CASE WHEN source = 'news' AND formal THEN 10 WHEN source = 'news' THEN 5 WHEN events > 0 THEN 7 ELSE 2 END AS source_points,
  CASE WHEN gov THEN 8 ELSE 0 END + CASE WHEN known THEN 5 ELSE 0 END AS url_points FROM {k.score(ARTICLES_SQL)}""")
def score_parts(spark, sf):
    from newsgauge import values as v

    title, media, source, url = F.col("title"), F.col("media"), F.col("source"), F.col("url")
    events = score.words_contained(title, v.EVENT_WORDS)
    return articles(spark, sf).select(
        "ord",
        score.length_points(title).alias("length_points"),
        score.event_points(events).alias("event_points"),
        score.progress_points(score.words_contained(title, v.PROGRESS_WORDS)).alias("progress_points"),
        score.structure_points(title).alias("structure_points"),
        score.source_points(source, media, events).alias("source_points"),
        score.url_points(url).alias("url_points"),
    )


@query("good_reports", f"SELECT ord, score FROM {k.score(ARTICLES_SQL)} WHERE score >= 15")
def good_reports(spark, sf):
    return score.good_reports(score.with_score(articles(spark, sf)).select("ord", "score"))


@query("score_stats", f"""SELECT count(*) AS total, count(*) FILTER (WHERE score >= 30) AS high, count(*) FILTER (WHERE score BETWEEN 15 AND 29) AS ok,
  count(*) FILTER (WHERE score BETWEEN 1 AND 14) AS low, count(*) FILTER (WHERE score <= 0) AS excluded FROM {k.score(ARTICLES_SQL)}""")
def score_stats(spark, sf):
    return score.score_stats(score.with_score(articles(spark, sf)))
