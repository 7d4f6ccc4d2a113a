"""Ranked lists, sheets and export files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.catalogue import checks as k
from newsgauge.catalogue.counting import _TIERED_SQL, tiered
from newsgauge.catalogue.registry import query, table
from newsgauge.catalogue.views import ARTICLES_SQL, articles
from newsgauge.operators import dedup, funnel, report, score
from newsgauge.session import use_checkpoint_dir
from newsgauge.sinks import files

_ORDER = f"{k.tier_rank('category')}, score DESC, date DESC, ord"
_SCORED_SQL = k.score(_TIERED_SQL)


def scored(spark, sf):
    return score.with_score(tiered(spark, sf)).withColumn("project", F.col("keyword"))


@query("ranked_report", f"SELECT ord, category, score, date, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM {_SCORED_SQL}")
def ranked_report(spark, sf):
    return report.with_rank(scored(spark, sf).select("ord", "category", "score", "date"))


@query("ranked_order", f"SELECT ord, category, score, date FROM {_SCORED_SQL}")
def ranked_order(spark, sf):
    return report.ranked(scored(spark, sf)).select("ord", "category", "score", "date")


@query("project_groups", f"""
WITH r AS (SELECT keyword AS project, ord, row_number() OVER (PARTITION BY keyword ORDER BY {_ORDER}) AS rank FROM {_SCORED_SQL}),
asked AS (SELECT DISTINCT keyword AS project FROM {ARTICLES_SQL} UNION SELECT DISTINCT c_mktsegment FROM customer)
SELECT project, COALESCE(ord, -1) AS ord, COALESCE(rank, 0) AS rank FROM asked LEFT JOIN r USING (project)""")
def project_groups(spark, sf):
    rows = scored(spark, sf).select("ord", "category", "score", "date", "project", "keyword")
    asked = rows.select("project").unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("project"))).distinct()
    asked = asked.select("project", F.col("project").alias("keyword"), F.lit(0).alias("keyword_rank"))
    listed = report.by_project(rows, asked)
    return listed.select(
        "project", F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("rank", F.lit(0)).alias("rank")
    )


@query("line_positions", """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem""")
def line_positions(spark, sf):
    """Row numbers inside three very large groups."""
    from newsgauge.operators.position import with_position

    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", *cols)
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in cols]]
    return with_position(rows, order, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "position")


@query("top_per_language", "SELECT doc_id, lang, rn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 40")
def top_per_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    top = dedup.top_n(docs, [F.col("lang")], [F.col("n_chars").desc(), F.col("doc_id")], v.MAX_PER_QUERY, "rn")
    return top.select("doc_id", "lang", F.col("rn").cast("long").alias("rn"))


_REJECTED_SQL = f"(SELECT *, {k.noise('title', 'snippet')} AS filter_reason FROM {ARTICLES_SQL} WHERE {k.noise('title', 'snippet')} IS NOT NULL)"


def rejected(spark, sf):
    rows = articles(spark, sf).withColumn("filter_reason", funnel.noise_reason(F.col("title"), F.col("snippet")))
    return rows.where("filter_reason IS NOT NULL").withColumn("project", F.col("keyword"))


@query("rejected_sample", f"SELECT ord, filter_reason FROM {_REJECTED_SQL} ORDER BY ord LIMIT 150")
def rejected_sample(spark, sf):
    return report.rejected_sample(rejected(spark, sf).select("ord", "filter_reason"), [F.col("ord")])


@query("rejected_sorted", f"SELECT ord, filter_reason FROM {_REJECTED_SQL}")
def rejected_sorted(spark, sf):
    return report.sort_rejected(rejected(spark, sf).select("ord", "filter_reason"))


_SHEET = """date AS "日期", title AS "文章标题", media AS "刊发媒体", category AS "媒体类别", url AS "媒体链接", snippet AS "摘要" """


@query("article_sheet", f"""SELECT row_number() OVER (ORDER BY {_ORDER}) AS "序号", {_SHEET}, CASE WHEN source = 'news' THEN '多源新闻' ELSE '微信公众号' END AS "数据来源" FROM {_SCORED_SQL}""")
def article_sheet(spark, sf):
    return report.article_sheet(scored(spark, sf))


@query("summary_sheet", f"""
WITH c AS (SELECT category, source FROM {_TIERED_SQL}), n AS (SELECT category, count(*) AS n FROM c GROUP BY category)
SELECT 1 AS seq, '搜索关键词' AS item, 'all' AS content UNION ALL SELECT 2, '日期范围', '2024-01-01 至 2024-12-31' UNION ALL SELECT 3, '发稿总数', (SELECT count(*)::VARCHAR FROM c)
UNION ALL SELECT 4, '', '' UNION ALL SELECT 5, '===== 按媒体类别统计 =====', ''
UNION ALL SELECT 10 + CASE category {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(v.SUMMARY_TIERS))} END, category, n::VARCHAR FROM n WHERE category IN ({', '.join(f"'{t}'" for t in v.SUMMARY_TIERS)})
UNION ALL SELECT 90, '', '' UNION ALL SELECT 91, '===== 按数据来源统计 =====', ''
UNION ALL SELECT 92, '多源新闻', (SELECT count(*)::VARCHAR FROM c WHERE source = 'news') UNION ALL SELECT 93, '微信公众号', (SELECT count(*)::VARCHAR FROM c WHERE source = 'wechat')""")
def summary_sheet(spark, sf):
    return report.summary_sheet(tiered(spark, sf), "all", "2024-01-01", "2024-12-31")


# --- files: written to the shared folder and read back -----------------------------------------------------

def _folder(spark) -> str:
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"


def _read_csv(spark, path, columns):
    return spark.read.options(**files.READ_CSV).schema(", ".join(f"`{c}` {t}" for c, t in columns)).csv(path)


@query("kept_csv", f"""SELECT row_number() OVER (ORDER BY {_ORDER}) AS "序号", {_SHEET} FROM {_SCORED_SQL}""")
def kept_csv(spark, sf):
    path = _folder(spark)
    files.write_kept_csv(scored(spark, sf), path)
    cols = [("序号", "bigint"), *[(c, "string") for c in ("日期", "文章标题", "刊发媒体", "媒体类别", "媒体链接", "摘要")]]
    back = _read_csv(spark, path, cols)
    return back.select("序号", *[F.coalesce(c, F.lit("")).alias(c) for c, _ in cols[1:]])


@query("scored_csv", f"""SELECT date AS "日期", keyword AS "项目", title AS "文章标题", media AS "刊发媒体", category AS "媒体类别", score AS "报道评分", url AS "媒体链接" FROM {_SCORED_SQL}""")
def scored_csv(spark, sf):
    path = _folder(spark)
    files.write_scored_csv(scored(spark, sf), path)
    cols = [(c, "int" if c == "报道评分" else "string") for c in ("日期", "项目", "文章标题", "刊发媒体", "媒体类别", "报道评分", "媒体链接")]
    back = _read_csv(spark, path, cols)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else c for c, t in cols])


@query("rejected_csv", f"""SELECT filter_reason AS "过滤原因", date AS "日期", keyword AS "项目", title AS "文章标题", media AS "刊发媒体", url AS "媒体链接" FROM {_REJECTED_SQL}""")
def rejected_csv(spark, sf):
    path = _folder(spark)
    files.write_rejected_csv(rejected(spark, sf), path)
    cols = [(c, "string") for c in ("过滤原因", "日期", "项目", "文章标题", "刊发媒体", "媒体链接")]
    back = _read_csv(spark, path, cols)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c, _ in cols])


@query("report_tsv", f"""SELECT date || chr(9) || keyword || chr(9) || regexp_replace(title, '[\\t\\r\\n]+', ' ', 'g') || chr(9) || media || chr(9) || category || chr(9) || url AS line FROM {_SCORED_SQL}""")
def report_tsv(spark, sf):
    path = _folder(spark)
    files.write_tsv(scored(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
