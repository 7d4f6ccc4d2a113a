"""Keyword resolution, query expansion and search over landed articles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.catalogue import checks as k
from newsgauge.catalogue.registry import query, table
from newsgauge.catalogue.filtering import DATE_FROM, DATE_TO, STATS_SQL, coverage_sql, landed_pages, link_targets
from newsgauge.catalogue.views import ARTICLES_SQL, SUBJECT_ROWS, articles, labels, outlets, sql_rows, subjects
from newsgauge.operators import keywords as kw, postings
from newsgauge.operators.lookup import INLINE_TERMS, match_terms
from newsgauge.plans.coverage import Dimensions, Settings
from newsgauge.plans.request import request_report, requested_articles
from newsgauge.plans.search import search_articles
from newsgauge.session import use_checkpoint_dir


# regions as subjects, their nations as aliases; customers ask for nations, regions and segments
def _region_subjects(spark, sf):
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("aliases"))
    return (
        table(spark, sf, "region")
        .join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .select(
            F.col("r_regionkey").alias("ord"), F.col("r_name").alias("primary"),
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
            F.array(F.concat("r_name", F.lit(" NEWS DESK")), F.lit("NATION_3")).alias("terms"),
        )
    )


def _asked(spark, sf):
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = table(spark, sf, "region")
    asked = customers.select("n_name").union(customers.select("c_mktsegment")).union(regions.select("r_name")).union(
        regions.select(F.concat("r_name", F.lit(" NEWS DESK")))
    )
    return asked.toDF("keyword").distinct()


_ASKED_SQL = """asked AS (SELECT DISTINCT keyword FROM (SELECT n_name AS keyword FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name || ' NEWS DESK' FROM region)),
subj AS (SELECT r_regionkey AS ord, r_name AS prim, COALESCE((SELECT list(n_name ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), []) AS aliases,
  [r_name || ' NEWS DESK', 'NATION_3'] AS terms FROM region),
names AS (SELECT ord, prim, prim AS name, 100 AS score FROM subj UNION ALL SELECT ord, prim, unnest(aliases), 90 FROM subj UNION ALL SELECT ord, prim, unnest(terms), 80 FROM subj),
hits AS (SELECT keyword, prim, ord, max(score) AS score FROM asked JOIN names ON keyword = name GROUP BY ALL),
best AS (SELECT keyword, arg_max(prim, score * 1000 - ord) AS prim, max(score) AS score FROM hits GROUP BY keyword)"""


@query("keyword_matches", f"WITH {_ASKED_SQL} SELECT keyword, prim AS \"primary\", score::BIGINT AS score FROM hits")
def keyword_matches(spark, sf):
    return kw.keyword_matches(_asked(spark, sf), _region_subjects(spark, sf)).select(
        "keyword", "primary", F.col("score").cast("long").alias("score")
    )


@query("keyword_resolve", f"WITH {_ASKED_SQL} SELECT keyword, COALESCE(prim, keyword) AS project, COALESCE(score, 0)::BIGINT AS score FROM asked LEFT JOIN best USING (keyword)")
def keyword_resolve(spark, sf):
    return kw.resolve_keywords(_asked(spark, sf), _region_subjects(spark, sf)).select(
        "keyword", "project", F.coalesce("score", F.lit(0)).cast("long").alias("score")
    )


_QUERIES_SQL = f"""list_filter([CASE WHEN prim IS NOT NULL AND length(terms[1]) >= 6 THEN terms[1] END, CASE WHEN prim IS NOT NULL AND length(terms[2]) >= 6 THEN terms[2] END, prim,
  aliases[1], aliases[2], aliases[3], aliases[4], prim || ' {' '.join(v.NEWS_WORDS)}', CASE WHEN length(prim) <= 6 THEN '{v.COMPANY_QUERY_PREFIX} ' || prim END, keyword], lambda x: x IS NOT NULL)"""


@query("search_queries", f"""WITH {_ASKED_SQL}, q AS (SELECT keyword, {_QUERIES_SQL} AS qs FROM asked LEFT JOIN best USING (keyword) LEFT JOIN subj USING (prim)),
e AS (SELECT keyword, unnest(qs) AS term, generate_subscripts(qs, 1) AS i FROM q), d AS (SELECT keyword, term, min(i) AS i FROM e GROUP BY ALL),
r AS (SELECT keyword, term, row_number() OVER (PARTITION BY keyword ORDER BY i) - 1 AS query_rank FROM d)
SELECT keyword, term, query_rank FROM r WHERE query_rank < 8""")
def search_queries(spark, sf):
    resolved = kw.resolve_keywords(_asked(spark, sf), _region_subjects(spark, sf))
    return resolved.select(
        "keyword", F.posexplode(kw.search_queries(F.col("keyword"), F.col("subject"))).alias("query_rank", "term")
    ).select("keyword", "term", F.col("query_rank").cast("long").alias("query_rank"))


_LITERALS = """CASE p_partkey % 6 WHEN 0 THEN concat(p_name, '项目') WHEN 1 THEN concat('青海省', p_name, '建设项目工程') WHEN 2 THEN concat('省', p_type)
  WHEN 3 THEN concat('内蒙古省', p_brand, '工程总承包') WHEN 4 THEN concat('呼和浩特省', '项目') ELSE p_name END"""
_TAIL = k.quote(v.SUBJECT_TAIL.replace("$", r"\z"))


@query("literal_variants", f"""
WITH p AS (SELECT p_partkey, {_LITERALS} AS kw FROM part), c AS (SELECT *, regexp_replace(kw, {_TAIL}, '') AS core FROM p),
n AS (SELECT *, replace(core, '省', '') AS np, core <> '' AND core <> kw AS cut FROM c)
SELECT p_partkey, array_to_string(list_filter([kw, CASE WHEN cut THEN core END, CASE WHEN cut AND core || '项目' <> kw THEN core || '项目' END,
  CASE WHEN cut AND core || '工程' <> kw THEN core || '工程' END, CASE WHEN np <> core AND length(np) >= 6 THEN np END], lambda x: x IS NOT NULL), '|') AS variants FROM n""")
def literal_variants(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(kw.literal_variants(F.expr(_LITERALS)), "|").alias("variants")
    )


@query("co_occurrence", f"""
WITH p AS (SELECT p_partkey, {_LITERALS} AS kw FROM part),
c AS (SELECT *, regexp_extract(kw, '^(.{{2,4}}?)省(.+)\\z', 1) AS region, regexp_replace(regexp_extract(kw, '^(.{{2,4}}?省)(.+)\\z', 2), {_TAIL}, '') AS core FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(kw, '^.{{2,4}}?省.+\\z') AND length(core) >= 5 THEN regexp_replace(regexp_extract(kw, '^(.{{2,4}}?省)(.+)\\z', 1), '省\\z', '') || '|' || core ELSE '' END AS pair FROM c""")
def co_occurrence(spark, sf):
    pair = F.array_join(kw.co_occurrence(F.expr(_LITERALS)), "|")
    return table(spark, sf, "part").select("p_partkey", F.coalesce(pair, F.lit("")).alias("pair"))


@query("search_plan", f"""
WITH k AS (SELECT DISTINCT lang AS keyword FROM documents), s AS {sql_rows(SUBJECT_ROWS, 'ord, prim, aliases, terms')}
SELECT keyword, COALESCE(prim, keyword) AS project, CASE WHEN prim IS NULL THEN keyword WHEN len(terms) > 0 THEN array_to_string(terms, '|') ELSE prim END AS match_terms,
  CASE WHEN prim IS NULL THEN 1 ELSE least(8, len(list_filter(terms, lambda t: length(t) >= 6)) + len(aliases) + 2 + CASE WHEN length(prim) <= 6 THEN 1 ELSE 0 END) END AS n_queries
FROM k LEFT JOIN s ON list_contains(s.aliases, k.keyword)""")
def search_plan(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("lang").alias("keyword")).distinct()
    return kw.plan_searches(kw.resolve_keywords(asked, subjects(spark))).select(
        "keyword", "project", F.array_join("match_terms", "|").alias("match_terms"), F.size("queries").cast("long").alias("n_queries")
    )


# --- search over articles --------------------------------------------------------------------------

_TERM = "text"


def _terms(spark, sf):
    """Search terms: the benchmark passages, whole."""
    return spark.sql(
        f"SELECT CAST(min(item_id) AS STRING) AS keyword, 0 AS keyword_rank, 0 AS query_rank, {_TERM} AS term FROM {{b}} GROUP BY {_TERM}",
        b=table(spark, sf, "benchmark"),
    )


_TERMS_SQL = f"(SELECT min(item_id)::VARCHAR AS keyword, {_TERM} AS term FROM benchmark GROUP BY {_TERM})"


@query("term_search", f"""
WITH h AS (SELECT t.keyword, t.term, a.ord, row_number() OVER (PARTITION BY t.keyword ORDER BY a.date DESC, a.ord) AS pos
  FROM {ARTICLES_SQL} a JOIN {_TERMS_SQL} t ON contains(a.title || a.snippet, t.term))
SELECT keyword, term, ord, pos FROM h""")
def term_search(spark, sf):
    hits = search_articles(articles(spark, sf), _terms(spark, sf))
    return hits.select("keyword", "term", "ord", F.col("pos").cast("long").alias("pos"))


_MATCHES_SQL = f"SELECT d.doc_id, t.keyword, t.term FROM documents d JOIN {_TERMS_SQL} t ON contains(d.text, t.term)"


def _matches(spark, sf, inline):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return match_terms(docs, F.col("text"), "doc_id", _terms(spark, sf), inline).select("doc_id", "keyword", "term")


@query("term_matches", _MATCHES_SQL)
def term_matches(spark, sf):
    return _matches(spark, sf, INLINE_TERMS)


@query("term_matches_large", _MATCHES_SQL)
def term_matches_large(spark, sf):
    """The same matches by the plan for term lists too large for the expression."""
    return _matches(spark, sf, 0)


@query("term_matches_indexed", _MATCHES_SQL)
def term_matches_indexed(spark, sf):
    """The same matches from a stored index, written in two batches."""
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/postings-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    odd = F.pmod("doc_id", F.lit(2)) == 1
    for name, batch in (("even", docs.where(~odd)), ("odd", docs.where(odd))):
        postings.add_articles(batch, F.col("text"), "doc_id", path, name)
    return postings.match_indexed(spark, path, _terms(spark, sf)).select(F.col("id").alias("doc_id"), "keyword", "term")


# the first three queries generated for each keyword from SUBJECT_ROWS
_REQUEST = ((0, "en", ("ing the ", "English desk", "en")), (1, "fr", ("Bureau", "fr", "bureau")),
            (2, "de", ("Redaktion Deutschland", "de", "Redaktion Deutschland " + " ".join(v.NEWS_WORDS))))
_REQUEST_SQL = sql_rows(tuple((r, k, i, q) for r, k, qs in _REQUEST for i, q in enumerate(qs)), "keyword_rank, keyword, query_rank, term")


_REQUESTED_SQL = f"""
WITH h AS (SELECT q.*, a.ord, row_number() OVER (PARTITION BY q.keyword, q.query_rank ORDER BY a.date DESC, a.ord) AS pos
  FROM {ARTICLES_SQL} a JOIN {_REQUEST_SQL} q ON contains(a.title || a.snippet, q.term)),
f AS (SELECT *, row_number() OVER (PARTITION BY keyword, ord ORDER BY query_rank, pos) AS n FROM h)
SELECT keyword, ord AS landed_ord, row_number() OVER (ORDER BY keyword_rank, query_rank, pos, ord) AS ord FROM f WHERE n = 1"""


def _asked_keywords(spark):
    return spark.createDataFrame([(k, r) for r, k, _ in _REQUEST], "keyword string, keyword_rank int")


@query("requested_articles", _REQUESTED_SQL)
def requested(spark, sf):
    return requested_articles(articles(spark, sf), _asked_keywords(spark), subjects(spark)).select("keyword", "landed_ord", "ord")


def _report(spark, sf):
    rows = articles(spark, sf)
    dims = Dimensions(subjects(spark), outlets(spark), labels(spark), link_targets(rows), landed_pages(rows))
    return request_report(rows, _asked_keywords(spark), dims, Settings(DATE_FROM, DATE_TO))


_REPORT_SQL = coverage_sql(
    f"(SELECT a.* EXCLUDE (ord, keyword), r.keyword, r.ord FROM {ARTICLES_SQL} a JOIN ({_REQUESTED_SQL}) r ON r.landed_ord = a.ord)",
    f"SELECT DISTINCT keyword, keyword_rank FROM {_REQUEST_SQL}")


@query("request_report", _REPORT_SQL + STATS_SQL)
def request_stats(spark, sf):
    """From keywords to the counts of a report: queries, search, funnel, score, ownership, names, tiers."""
    return _report(spark, sf).stats()


@query("request_projects", _REPORT_SQL + """
SELECT r.keyword, t.project, count(d.ord) FILTER (WHERE d.filter_reason IS NULL AND NOT d.elsewhere) AS n_kept, count(d.ord) AS n_raw
FROM ranks r JOIN terms t USING (keyword) LEFT JOIN done d ON d.project = t.project GROUP BY r.keyword, t.project""")
def request_projects(spark, sf):
    return _report(spark, sf).by_project()
