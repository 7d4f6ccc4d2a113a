"""Outlet tiers, outlet names, labels and link lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.catalogue import checks as k
from newsgauge.catalogue.filtering import _tier, link_targets, landed_pages
from newsgauge.catalogue.registry import query, table
from newsgauge.catalogue.views import ARTICLES_SQL, articles, labels, outlets, quote
from newsgauge.operators import classify, funnel, lookup, verify
from newsgauge.session import use_checkpoint_dir

_WORDS = ((1, "red widget", "A"), (2, "ring", "B"), (3, "large rod extra", "C"), (4, "e", "D"))


def _first(name: str, both: bool) -> str:
    def hit(w: str) -> str:
        return f"contains({name}, {quote(w)})" + (f" OR contains({quote(w)}, {name})" if both else "")
    return (
        "COALESCE(CASE " + " ".join(f"WHEN {name} = {quote(w)} THEN {quote(x)}" for _, w, x in _WORDS) + " END, CASE "
        + " ".join(f"WHEN {hit(w)} THEN {quote(x)}" for _, w, x in _WORDS) + " END, '')"
    )


_DICTIONARY_SQL = f"""SELECT p_partkey, {_first('p_name', True)} AS either, {_first('p_name', False)} AS inside FROM part"""


def _dictionary(spark, sf, inline):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    words = spark.createDataFrame(_WORDS, "ord int, key string, value string")
    names = parts.select("p_name").distinct()
    either = lookup.first_match(names, "p_name", words, both_ways=True, inline=inline).withColumnRenamed("value", "either")
    inside = lookup.first_match(names, "p_name", words, inline=inline).withColumnRenamed("value", "inside")
    out = parts.join(either, "p_name").join(inside, "p_name")
    return out.select("p_partkey", *[F.coalesce(c, F.lit("")).alias(c) for c in ("either", "inside")])


@query("dictionary_lookup", _DICTIONARY_SQL)
def dictionary_lookup(spark, sf):
    return _dictionary(spark, sf, lookup.INLINE_ENTRIES)


@query("dictionary_lookup_large", _DICTIONARY_SQL)
def dictionary_lookup_large(spark, sf):
    """The same lookup by the plan for dictionaries too large for the expression."""
    return _dictionary(spark, sf, 0)


@query("domain_tiers", f"SELECT page_id, COALESCE({k.first_pair('lower(url)', v.DOMAIN_TIERS + (('example.org', '行业'), ('example', '地方')))}, '') AS tier FROM pages")
def domain_tiers(spark, sf):
    pairs = v.DOMAIN_TIERS + (("example.org", "行业"), ("example", "地方"))
    return table(spark, sf, "pages").select(
        "page_id", F.coalesce(classify.domain_tier(F.col("url"), pairs), F.lit("")).alias("tier")
    )


_DOMAIN = f"COALESCE({k.first_pair('lower(media)', v.DOMAIN_OUTLETS)}, {k.first_pair('lower(url)', v.DOMAIN_OUTLETS)})"
_FIXED = f"source = 'news' AND {k.unreliable('media')} AND {_DOMAIN} IS NOT NULL"


@query("outlet_from_domain", f"SELECT ord, CASE WHEN {_FIXED} THEN {_DOMAIN} ELSE media END AS media, CASE WHEN {_FIXED} THEN 'domain' ELSE '' END AS fix FROM {ARTICLES_SQL}")
def outlet_from_domain(spark, sf):
    return verify.correct_by_domain(articles(spark, sf)).select(
        "ord", "media", F.coalesce("media_fix", F.lit("")).alias("fix")
    )


_CITIES = ("某某", "大同")


_NAMED_TIERS_SQL = f"""
WITH n AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN media || '日报' WHEN ord % 5 = 1 THEN ' ' || media || '融媒体 ' WHEN ord % 5 = 2 THEN '山西' || media || '新闻网' ELSE media END AS media FROM {ARTICLES_SQL}),
t AS (SELECT *, {k.trim('media')} AS name FROM n)
SELECT ord, {_tier('name').replace(k.rule_tier('name'), k.rule_tier('name', _CITIES))} AS category FROM t"""


def _named(spark, sf):
    n, media = F.col("ord") % 5, F.col("media")
    return articles(spark, sf).select(
        "ord",
        F.when(n == 0, F.concat(media, F.lit("日报")))
        .when(n == 1, F.concat(F.lit(" "), media, F.lit("融媒体 ")))
        .when(n == 2, F.concat(F.lit("山西"), media, F.lit("新闻网")))
        .otherwise(media)
        .alias("media"),
    )


@query("outlet_tiers", _NAMED_TIERS_SQL)
def outlet_tiers(spark, sf):
    return classify.with_category(_named(spark, sf), "ord", outlets(spark), _CITIES, labels(spark)).select("ord", "category")


@query("outlet_tiers_stored", _NAMED_TIERS_SQL)
def outlet_tiers_stored(spark, sf):
    """The same tiers from a store that a run over some articles began and a run over all completes."""
    use_checkpoint_dir(spark)
    store = f"{spark.sparkContext.getCheckpointDir()}/outlets-{uuid.uuid4().hex}"
    rows = _named(spark, sf)
    classify.stored_tiers(store, rows.where("ord % 3 = 0").select("media").distinct(), outlets(spark), _CITIES)
    return classify.with_category(rows, "ord", outlets(spark), _CITIES, labels(spark), store=store).select("ord", "category")


@query("newspaper_tiers", f"""WITH n AS (SELECT doc_id, source || CASE doc_id % 6 WHEN 0 THEN '大同日报' WHEN 1 THEN '北京晚报' WHEN 2 THEN '都市报'
  WHEN 3 THEN '建筑' WHEN 4 THEN '新闻网' ELSE '' END AS name FROM documents) SELECT doc_id, {k.rule_tier('name', ('大同',))} AS tier FROM n""")
def newspaper_tiers(spark, sf):
    kinds = "concat(source, CASE doc_id % 6 WHEN 0 THEN '大同日报' WHEN 1 THEN '北京晚报' WHEN 2 THEN '都市报' WHEN 3 THEN '建筑' WHEN 4 THEN '新闻网' ELSE '' END)"
    docs = table(spark, sf, "documents").select("doc_id", F.expr(kinds).alias("media"))
    return classify.with_category(docs, "doc_id", cities=("大同",)).select("doc_id", F.col("category").alias("tier"))


# external labels: the quality label of a document stands for the answer of whoever labels outlets
_LABELLED = """SELECT d.doc_id, concat('outlet ', md5(d.text)) AS media,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN '微信公众号' WHEN l.quality = 0 THEN '个人账号' WHEN l.toxic = 1 THEN 'nonsense' END AS label
  FROM {d} d LEFT JOIN {l} l ON d.doc_id = l.doc_id"""


def _label_case(spark, sf):
    rows = spark.sql(_LABELLED, d=table(spark, sf, "documents"), l=table(spark, sf, "labels"))
    given = rows.where("label IS NOT NULL").groupBy("media").agg(F.max("label").alias("category"))
    return rows.select("doc_id", "media"), given


_LABELS_SQL = "WITH r AS (" + _LABELLED.replace("{d}", "documents").replace("{l}", "labels") + "), g AS (SELECT media, max(label) AS label FROM r WHERE label IS NOT NULL GROUP BY media)"


@query("label_fallback", _LABELS_SQL + f" SELECT r.doc_id, CASE WHEN g.label IS NULL THEN '未分类' ELSE {k.label_tier('g.label')} END AS category FROM r LEFT JOIN g USING (media)")
def label_fallback(spark, sf):
    rows, given = _label_case(spark, sf)
    return classify.with_category(rows, "doc_id", labels=given).select("doc_id", "category")


@query("unlabelled_outlets", _LABELS_SQL + " SELECT DISTINCT r.media FROM r LEFT JOIN g USING (media) WHERE g.label IS NULL")
def unlabelled_outlets(spark, sf):
    rows, given = _label_case(spark, sf)
    return classify.unlabelled_outlets(classify.classify_outlets(rows.select("media").distinct(), labels=given))


_LINK_SQL = "CASE WHEN contains(url, 'news.google.com') AND md5(url)[1] < '8' THEN 'https://www.thepaper.cn/' || md5(url) ELSE url END"


@query("link_resolution", f"SELECT ord, {k.decode(_LINK_SQL, v.URL_ENTITIES)} AS url FROM {ARTICLES_SQL}")
def link_resolution(spark, sf):
    rows = articles(spark, sf)
    return verify.clean_links(verify.resolve_links(rows, link_targets(rows))).select("ord", "url")


_PAGE_SQL = f"""
WITH w AS (SELECT *, source = 'news' AND {k.unreliable('media')} AS wanted FROM {ARTICLES_SQL}),
c AS (SELECT *, wanted AND row_number() OVER (PARTITION BY wanted, url ORDER BY ord) = 1 AS checked, md5(url)[1] AS h FROM w),
r AS (SELECT ord, CASE WHEN checked AND h < 'a' THEN '内蒙古新闻在线' ELSE media END AS media,
  CASE WHEN checked AND h < '4' AND NOT contains(url, 'news.google.com') THEN url || '#final' ELSE url END AS url,
  CASE WHEN checked AND h < 'a' THEN 'corrected' WHEN checked THEN 'skipped' ELSE '' END AS page_result FROM c)"""


@query("page_correction", _PAGE_SQL + " SELECT * FROM r")
def page_correction(spark, sf):
    return _by_page(spark, sf).select("ord", "media", "url", F.coalesce("page_result", F.lit("")).alias("page_result"))


def _by_page(spark, sf):
    rows = articles(spark, sf)
    return verify.correct_by_page(verify.flag_page_checks(rows), landed_pages(rows))


@query("verification_stats", _PAGE_SQL + """ SELECT count(*) FILTER (WHERE page_result <> '') AS checked,
  count(*) FILTER (WHERE page_result = 'corrected') AS corrected, count(*) FILTER (WHERE page_result = 'skipped') AS skipped FROM r""")
def verification_stats(spark, sf):
    return verify.verification_stats(_by_page(spark, sf).withColumn("media_fix", F.lit(None).cast("string")))


@query("finalised", f"""WITH t AS (SELECT ord, media, {_tier('media')} AS category FROM {ARTICLES_SQL})
SELECT ord, CASE WHEN regexp_matches(media, '八局|中建|中国建筑') THEN '自身发布内容' WHEN category = '个人账号' THEN '个人账号' ELSE '' END AS reason, category FROM t""")
def finalised(spark, sf):
    rows = classify.with_category(articles(spark, sf).select("ord", "media"), "ord", outlets(spark), labels=labels(spark))
    reason = F.when(funnel.own_account(F.col("media")), v.REASON_OWN).when(F.col("category") == v.PERSONAL, v.REASON_PERSONAL)
    return rows.select("ord", F.coalesce(reason, F.lit("")).alias("reason"), "category")


@query("personal_accounts", f"SELECT ord, media FROM {ARTICLES_SQL} WHERE {_tier('media')} = '个人账号'")
def personal_accounts(spark, sf):
    rows = classify.with_category(articles(spark, sf).select("ord", "media"), "ord", outlets(spark), labels=labels(spark))
    return rows.where(F.col("category") == v.PERSONAL).select("ord", "media")


