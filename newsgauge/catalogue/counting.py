"""Counts and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgauge.catalogue import checks as k
from newsgauge.catalogue.filtering import _tier
from newsgauge.catalogue.registry import query, table
from newsgauge.catalogue.views import ARTICLES_SQL, articles, labels, outlets
from newsgauge.functions.urls import canonical_url
from newsgauge.operators import classify, funnel, report
from newsgauge.session import cut, use_checkpoint_dir
from newsgauge.streaming.ledger import Ledger


def tiered(spark, sf):
    return classify.with_category(articles(spark, sf), "ord", outlets(spark), labels=labels(spark))


_TIERED_SQL = f"(SELECT *, {_tier('media')} AS category FROM {ARTICLES_SQL})"


@query("tier_counts", f"SELECT category, count(*) AS n FROM {_TIERED_SQL} GROUP BY category")
def tier_counts(spark, sf):
    return report.count_by(tiered(spark, sf), "category")


@query("tier_cards", f"SELECT CASE WHEN category = '未分类' THEN '其他' ELSE category END AS label, count(*) AS n FROM {_TIERED_SQL} GROUP BY category")
def tier_cards(spark, sf):
    return report.tier_cards(tiered(spark, sf))


@query("source_counts", f"SELECT count(*) FILTER (WHERE source = 'news') AS news, count(*) FILTER (WHERE source <> 'news') AS wechat FROM {ARTICLES_SQL}")
def source_counts(spark, sf):
    return report.source_counts(articles(spark, sf))


_KEEP = "regexp_matches(title, '[！!]|封顶')"


@query("project_counts", f"""
WITH a AS (SELECT keyword AS project, {_KEEP} AS kept FROM {ARTICLES_SQL}), c AS (SELECT DISTINCT 'for ' || keyword AS keyword, keyword AS project FROM {ARTICLES_SQL}
  UNION ALL SELECT 'for ' || c_mktsegment, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c.keyword, c.project, count(a.project) FILTER (WHERE a.kept) AS n_kept, count(a.project) AS n_raw FROM c LEFT JOIN a ON a.project = c.project GROUP BY c.keyword, c.project""")
def project_counts(spark, sf):
    rows = articles(spark, sf).withColumn("project", F.col("keyword"))
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("project"))
    asked = rows.select("project").unionByName(segments).distinct()
    asked = asked.select(F.concat(F.lit("for "), "project").alias("keyword"), "project")
    return report.count_by_project(asked, rows.where(F.col("title").rlike("[！!]|封顶")), rows)


@query("reason_counts", f"SELECT {k.noise('title', 'snippet')} AS filter_reason, count(*) AS n FROM {ARTICLES_SQL} WHERE {k.noise('title', 'snippet')} IS NOT NULL GROUP BY 1")
def reason_counts(spark, sf):
    rows = articles(spark, sf).select(funnel.noise_reason(F.col("title"), F.col("snippet")).alias("filter_reason"))
    return report.count_by(rows.where("filter_reason IS NOT NULL"), "filter_reason")


@query("totals", "SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS shown FROM lineitem")
def totals(spark, sf):
    return report.totals(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R")


_DIMS = ("l_returnflag", "l_linestatus", "l_linenumber")


@query("grouped_stats", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d}::VARCHAR AS key, count(*) AS n FROM lineitem GROUP BY {d}" for d in _DIMS
) + " UNION ALL SELECT 'total', '', count(*) FROM lineitem")
def grouped_stats(spark, sf):
    return report.report_stats(table(spark, sf, "lineitem").select(*_DIMS), _DIMS)


@query("partial_merge", """SELECT event_type AS dimension, CASE WHEN value >= 10 THEN 'high' ELSE 'low' END AS key, count(*) AS n FROM events GROUP BY 1, 2""")
def partial_merge(spark, sf):
    """Counts per day, stored as partials, then added up."""
    events = table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("dimension"),
        F.when(F.col("value") >= 10, "high").otherwise("low").alias("key"),
    )
    daily = events.groupBy("day", "dimension", "key").agg(F.count("*").alias("n"))
    return report.merge_partials(daily)


_LEDGER_FACTS = f"""SELECT ord % 40 AS payload, CASE WHEN ord // 40 % 2 = 0 THEN 2 ELSE 1 END AS version, keyword, {k.canonical('url')} AS url_key, ord, {k.noise('title', 'snippet')} AS reason, source
  FROM {ARTICLES_SQL}"""


@query("ledger_counts", f"""
WITH f AS ({_LEDGER_FACTS}), l AS (SELECT payload, max(version) AS version FROM f GROUP BY payload), n AS (SELECT f.* FROM f JOIN l USING (payload, version)),
w AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY keyword, url_key, reason IS NULL ORDER BY ord) END AS place FROM n)
SELECT keyword, 'outcome' AS dimension, CASE WHEN reason IS NOT NULL THEN reason WHEN place = 1 THEN 'kept' ELSE '重复内容' END AS key, count(*) AS n FROM w GROUP BY ALL
UNION ALL SELECT keyword, 'source', source, count(*) FROM w WHERE place = 1 GROUP BY ALL""")
def ledger_counts(spark, sf):
    """Increments of batches in the wrong order: a payload's newer version may come before the older, first links come last, and a batch comes twice."""
    use_checkpoint_dir(spark)
    ledger = Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}", 8)
    rows = articles(spark, sf).select(
        F.lpad((F.col("ord") % 40).cast("string"), 2, "0").alias("payload"), F.when(F.floor(F.col("ord") / 40) % 2 == 0, "2").otherwise("1").alias("version"), "keyword",
        canonical_url(F.col("url")).alias("url_key"), F.lpad(F.col("ord").cast("string"), 19, "0").alias("ord"),
        funnel.noise_reason(F.col("title"), F.col("snippet")).alias("reason"), "source")
    rows = cut(rows)
    late = F.col("payload") < "20"
    for batch, part in enumerate((rows.where(~late & (F.col("version") == "1")), rows.where(late & (F.col("version") == "2")), rows.where(F.col("version") == "1"), rows.where("version = '2'"))):
        ledger.apply(part, batch)
    return ledger.counts()
