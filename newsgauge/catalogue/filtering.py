"""Funnel rules, and the whole coverage job."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.catalogue import checks as k
from newsgauge.catalogue.registry import query, table
from newsgauge.catalogue.views import (
    ARTICLES_SQL, LABEL_ROWS, OUTLET_ROWS, SUBJECT_ROWS, articles, labels, outlets, quote, sql_array, sql_rows, subjects,
)
from newsgauge.operators import funnel, keywords as kw, score
from newsgauge.operators.joins import attach
from newsgauge.plans.coverage import Dimensions, Report, Settings, coverage_report, unrequested_articles
from newsgauge.session import cut

DATE_FROM, DATE_TO = "2024-02-01", "2024-10-31"


@query("date_range", """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT o_orderkey, d FROM o WHERE NOT regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z') OR d BETWEEN '1995-01-01' AND '1996-12-31'""")
def date_range(spark, sf):
    n = F.col("o_orderkey") % 10
    day = F.when(n == 0, "").when(n == 1, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", day.alias("d"))
        .where(funnel.in_date_range(F.col("d"), "1995-01-01", "1996-12-31"))
    )


@query("own_accounts", f"""SELECT ord, media FROM {ARTICLES_SQL} WHERE regexp_matches(media, '八局|中建|中国建筑')
  UNION ALL SELECT c_custkey AS ord, c_mktsegment AS media FROM customer WHERE regexp_matches(c_mktsegment, 'BUILD|HOUSE')""")
def own_accounts(spark, sf):
    rows = articles(spark, sf).select("ord", "media").where(funnel.own_account(F.col("media")))
    segments = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("media"))
    return rows.unionByName(segments.where(funnel.own_account(F.col("media"), "BUILD|HOUSE")))


@query("noise_reasons", f"""SELECT ord, {k.noise('title', 'snippet')} AS reason FROM {ARTICLES_SQL} WHERE {k.noise('title', 'snippet')} IS NOT NULL""")
def noise_reasons(spark, sf):
    reason = funnel.noise_reason(F.col("title"), F.col("snippet"))
    return articles(spark, sf).select("ord", reason.alias("reason")).where("reason IS NOT NULL")


_LATIN_RULES = (
    (r"license|License", "license"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "mail"),
    (r"[0-9]{3}-[0-9]{4}", "phone"),
    (r"^.{0,19}$", "short"),
)


@query("rejected_by_reason", "WITH d AS (SELECT CASE " + " ".join(
    f"WHEN {k.matches('text', p)} THEN {quote(r)}" for p, r in _LATIN_RULES) + """ END AS reason FROM documents)
SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY reason""")
def rejected_by_reason(spark, sf):
    docs = table(spark, sf, "documents").select(funnel.first_reason(F.col("text"), _LATIN_RULES).alias("reason"))
    return docs.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


_KEYWORDS_SQL = "(SELECT DISTINCT lang AS keyword FROM documents)"
_SUBJECTS_SQL = sql_rows(SUBJECT_ROWS, "ord, prim, aliases, terms")
# terms a literal keyword stands for; none of these keywords ends in a word that is stripped
_TERMS_SQL = f"""SELECT k.keyword, COALESCE(s.prim, k.keyword) AS project,
  CASE WHEN s.prim IS NULL THEN [k.keyword] WHEN len(s.terms) > 0 THEN s.terms ELSE [s.prim] END AS terms
  FROM {_KEYWORDS_SQL} k LEFT JOIN {_SUBJECTS_SQL} s ON list_contains(s.aliases, k.keyword)"""


@query("precision_terms", f"""
WITH t AS ({_TERMS_SQL})
SELECT a.ord, t.project, len(list_filter(t.terms, lambda x: contains(a.title || a.snippet, x))) > 0 AS mentioned
FROM {ARTICLES_SQL} a JOIN t USING (keyword)""")
def precision_terms(spark, sf):
    rows = articles(spark, sf)
    plan = kw.plan_searches(kw.resolve_keywords(request_keywords(rows), subjects(spark)))
    # written, its size is known: a short plan is broadcast, beside a long one a common keyword is spread over tasks
    plan = cut(plan.select("keyword", "project", "match_terms", "co_occur"))
    text = F.concat("title", "snippet")
    return attach(rows, plan, "keyword", "ord", how="inner").select(
        "ord", "project", funnel.mentions_subject(text, F.col("match_terms"), F.col("co_occur")).alias("mentioned")
    )


@query("low_scores", f"SELECT ord, score FROM {k.score(ARTICLES_SQL)} WHERE score < 0")
def low_scores(spark, sf):
    return score.with_score(articles(spark, sf)).where("score < 0").select("ord", "score")


@query("result_view", f"""SELECT ord, score, source FROM {k.score(ARTICLES_SQL)} WHERE source = 'news' AND {k.rule_tier('media')} = '行业'""")
def result_view(spark, sf):
    from newsgauge.operators.classify import with_category

    scored = with_category(score.with_score(articles(spark, sf)))
    return funnel.only(scored, category=v.INDUSTRY, source="news").select("ord", "score", "source")


@query("keyword_hygiene", """
WITH k AS (SELECT trim(CASE doc_id % 3 WHEN 0 THEN '  ' || source || ' ' WHEN 1 THEN source ELSE '　' END, ' 　') AS keyword, doc_id FROM documents)
SELECT keyword, min(doc_id) AS keyword_rank FROM k WHERE keyword <> '' GROUP BY keyword""")
def keyword_hygiene(spark, sf):
    n = F.col("doc_id") % 3
    raw = F.when(n == 0, F.concat(F.lit("  "), "source", F.lit(" "))).when(n == 1, F.col("source")).otherwise("　")
    return kw.clean_keywords(
        table(spark, sf, "documents").select(raw.alias("keyword"), F.col("doc_id").alias("keyword_rank"))
    )


# --- the whole job ------------------------------------------------------------------------------------

def request_keywords(rows):
    """Every keyword of the article view, in the order of their first articles."""
    return rows.groupBy("keyword").agg(F.min("ord").alias("keyword_rank"))


def landed_pages(rows):
    """Article pages for the redirect and platform links, derived from the articles themselves."""
    return (
        rows.select("url", F.substring(F.md5("url"), 1, 1).alias("h"))
        .distinct()
        .select(
            "url",
            F.when(F.col("h") < "4", F.concat("url", F.lit("#final"))).otherwise("").alias("final_url"),
            F.concat(
                F.lit("<html><head>"),
                F.when(F.col("h") < "a", '<meta property="og:site_name" content="内蒙古新闻在线">').otherwise(""),
                F.lit("</head>"),
                F.repeat(F.lit(" "), 1000),
            ).alias("html"),
        )
    )


def link_targets(rows):
    """Known targets of redirect links, derived from the articles."""
    from newsgauge.functions.urls import is_redirect

    u = F.col("url")
    return rows.select("url").where(is_redirect(u) & (F.substring(F.md5(u), 1, 1) < "8")).distinct().select(
        "url", F.concat(F.lit("https://www.thepaper.cn/"), F.md5(u)).alias("final_url")
    )


def run_coverage(spark, sf) -> Report:
    rows = articles(spark, sf)
    dims = Dimensions(subjects(spark), outlets(spark), labels(spark), link_targets(rows), landed_pages(rows))
    return coverage_report(rows, request_keywords(rows), dims, Settings(DATE_FROM, DATE_TO))


def _tier(name: str) -> str:
    exact = "CASE " + " ".join(f"WHEN {name} = {quote(o[1])} THEN {quote(o[2])}" for o in OUTLET_ROWS) + " END"
    either = "CASE " + " ".join(
        f"WHEN contains({name}, {quote(o[1])}) OR contains({quote(o[1])}, {name}) THEN {quote(o[2])}" for o in OUTLET_ROWS
    ) + " END"
    rule = f"COALESCE({exact}, {either}, {k.rule_tier(name)})"
    label = "CASE " + " ".join(f"WHEN {name} = {quote(m)} THEN {k.label_tier(quote(c))}" for m, c in LABEL_ROWS) + " END"
    return f"(CASE WHEN {rule} = '未分类' THEN COALESCE({label}, '未分类') ELSE {rule} END)"


_KEPT_URL = k.decode("url", v.URL_ENTITIES)
_DOMAIN_NAME = f"COALESCE({k.first_pair('lower(media)', v.DOMAIN_OUTLETS)}, {k.first_pair('lower(url)', v.DOMAIN_OUTLETS)})"


def coverage_sql(rows: str = ARTICLES_SQL, ranks: str = "SELECT lang AS keyword, min(doc_id) AS keyword_rank FROM documents GROUP BY lang") -> str:
    """Common tables of the checking engine for the whole job over ``rows``; ``done`` has each row's outcome."""
    return f"""
WITH terms AS ({_TERMS_SQL}),
ranks AS ({ranks}),
raw AS (SELECT a.*, t.project, t.terms, r.keyword_rank FROM {rows} a JOIN terms t USING (keyword) JOIN ranks r USING (keyword)
  WHERE NOT regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\z') OR date BETWEEN '{DATE_FROM}' AND '{DATE_TO}'),
f1 AS (SELECT *, CASE WHEN regexp_matches(media, '八局|中建|中国建筑') THEN '自身发布内容' ELSE COALESCE({k.noise('title', 'snippet')},
  CASE WHEN len(list_filter(terms, lambda x: contains(title || snippet, x))) = 0 THEN '未提到具体项目名' END) END AS r1 FROM raw),
f2 AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY keyword, r1 IS NULL, {k.canonical('url')} ORDER BY ord) > 1
  THEN '重复内容' ELSE r1 END AS r2 FROM f1),
f3 AS (SELECT *, CASE WHEN r2 IS NULL AND score < 0 THEN '报道评分不足' ELSE r2 END AS r3 FROM {k.score('f2')}),
f4 AS (SELECT *, CASE WHEN r3 IS NULL THEN {_tier('media')} END AS cat1 FROM f3),
f5 AS (SELECT * REPLACE (CASE WHEN contains(url, 'news.google.com') AND md5(url)[1] < '8'
    THEN 'https://www.thepaper.cn/' || md5(url) ELSE url END AS url), CASE WHEN r3 IS NULL AND cat1 = '个人账号' THEN '个人账号' ELSE r3 END AS r5 FROM f4),
f6 AS (SELECT *, row_number() OVER (PARTITION BY r5 IS NULL, url
    ORDER BY keyword_rank, {k.tier_rank('cat1')}, score DESC, date DESC, ord) AS owner FROM f5),
f7 AS (SELECT * REPLACE ({_KEPT_URL} AS url), r5 IS NULL AND owner > 1 AS elsewhere, r5 IS NULL AND owner = 1 AS live FROM f6),
f8 AS (SELECT * REPLACE (CASE WHEN live AND source = 'news' AND {k.unreliable('media')} THEN COALESCE({_DOMAIN_NAME}, media) ELSE media END AS media),
    live AND source = 'news' AND {k.unreliable('media')} AND {_DOMAIN_NAME} IS NOT NULL AS by_domain FROM f7),
f9 AS (SELECT *, live AND source = 'news' AND {k.unreliable('media')} AS wanted FROM f8),
f10 AS (SELECT *, wanted AND row_number() OVER (PARTITION BY wanted, url ORDER BY ord) = 1 AS checked FROM f9),
landed AS (SELECT DISTINCT url AS page_url, md5(url)[1] AS h FROM {ARTICLES_SQL}),
f11 AS (SELECT f10.* REPLACE (CASE WHEN checked AND h < 'a' THEN '内蒙古新闻在线' ELSE media END AS media,
    CASE WHEN checked AND h < '4' AND NOT contains(url, 'news.google.com') THEN url || '#final' ELSE url END AS url),
    CASE WHEN checked AND h < 'a' THEN 'corrected' WHEN checked THEN 'skipped' END AS page_result
  FROM f10 LEFT JOIN landed ON checked AND f10.url = landed.page_url),
f12 AS (SELECT *, CASE WHEN live THEN {_tier('media')} ELSE cat1 END AS category FROM f11),
done AS (SELECT *, CASE WHEN live AND regexp_matches(media, '八局|中建|中国建筑') THEN '自身发布内容'
    WHEN live AND category = '个人账号' THEN '个人账号' ELSE r5 END AS filter_reason FROM f12)"""


_COVERAGE_SQL = coverage_sql()
STATS_SQL = """, shown AS (SELECT CASE WHEN filter_reason IS NULL THEN category END AS category,
  CASE WHEN filter_reason IS NULL THEN source END AS source, CASE WHEN filter_reason IS NULL THEN project END AS project, filter_reason,
  CASE WHEN filter_reason IS NULL THEN 'kept' ELSE 'filtered' END AS status FROM done WHERE NOT elsewhere)
SELECT 'category' AS dimension, category AS key, count(*) AS n FROM shown WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'source', source, count(*) FROM shown WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'project', project, count(*) FROM shown WHERE project IS NOT NULL GROUP BY project
UNION ALL SELECT 'filter_reason', filter_reason, count(*) FROM shown WHERE filter_reason IS NOT NULL GROUP BY filter_reason
UNION ALL SELECT 'status', status, count(*) FROM shown GROUP BY status
UNION ALL SELECT 'total', '', count(*) FROM shown"""


@query("coverage_rows", _COVERAGE_SQL + """
SELECT ord, project, title, media, url, COALESCE(category, '') AS category, CASE WHEN r2 IS NULL THEN score ELSE -999 END AS score, COALESCE(filter_reason, '') AS filter_reason,
  CASE WHEN elsewhere THEN 'owned_elsewhere' WHEN filter_reason IS NULL THEN 'kept' ELSE 'filtered' END AS status FROM done""")
def coverage_rows(spark, sf):
    report = run_coverage(spark, sf)
    return report.with_texts(report.rows, ("title",)).select(
        "ord", "project", "title", "media", "url", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("score", F.lit(-999)).alias("score"),
        F.coalesce("filter_reason", F.lit("")).alias("filter_reason"), "status",
    )


@query("coverage_report", _COVERAGE_SQL + STATS_SQL)
def coverage_stats(spark, sf):
    return run_coverage(spark, sf).stats()


@query("coverage_verification", _COVERAGE_SQL + """
SELECT count(page_result) AS checked, count(*) FILTER (WHERE by_domain) + count(*) FILTER (WHERE page_result = 'corrected') AS corrected,
  count(*) FILTER (WHERE page_result = 'skipped') AS skipped FROM done""")
def coverage_verification(spark, sf):
    return run_coverage(spark, sf).verification()


@query("coverage_by_project", _COVERAGE_SQL + """
SELECT r.keyword, t.project, count(d.ord) FILTER (WHERE d.filter_reason IS NULL AND NOT d.elsewhere) AS n_kept, count(d.ord) AS n_raw
FROM ranks r JOIN terms t USING (keyword) LEFT JOIN done d ON d.project = t.project GROUP BY r.keyword, t.project""")
def coverage_by_project(spark, sf):
    return run_coverage(spark, sf).by_project()


@query("coverage_funnel", _COVERAGE_SQL + """
SELECT project, count(*) AS in_range, count(*) FILTER (WHERE r1 IS NULL OR r1 = '未提到具体项目名') AS after_content,
  count(*) FILTER (WHERE r1 IS NULL) AS after_precision, count(*) FILTER (WHERE r2 IS NULL) AS after_dedup,
  count(*) FILTER (WHERE r3 IS NULL) AS after_score FROM done GROUP BY project""")
def coverage_funnel(spark, sf):
    return run_coverage(spark, sf).funnel()


@query("unrequested_articles", f"SELECT ord, keyword FROM {ARTICLES_SQL} WHERE keyword NOT IN ('en', 'fr')")
def unrequested(spark, sf):
    asked = spark.createDataFrame([(" en ", 0), ("fr", 1), ("　", 2)], "keyword string, keyword_rank int")
    return unrequested_articles(articles(spark, sf), asked).select("ord", "keyword")
