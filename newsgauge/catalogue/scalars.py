"""Text, link and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.catalogue import checks as k
from newsgauge.catalogue.registry import query, table
from newsgauge.catalogue.views import ARTICLES_SQL, AS_OF, articles, quote
from newsgauge.functions import dates, text as t, urls
from newsgauge.sources.payloads import short_outlet

# --- text ---------------------------------------------------------------------------------------------


@query("html_text", f"""SELECT page_id, {k.trim(k.squeeze(k.strip_tags('html', ' ')))} AS text,
  length({k.strip_tags('html')}) AS n_untagged FROM pages""")
def html_text(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", t.html_to_text(html).alias("text"), F.length(t.strip_tags(html)).cast("long").alias("n_untagged")
    )


_ENTITY_LISTS = {
    "as_url": v.URL_ENTITIES, "as_rss": v.RSS_TITLE_ENTITIES, "as_rss_snippet": v.RSS_SNIPPET_ENTITIES,
    "as_api": v.API_ENTITIES, "as_wechat": v.WECHAT_ENTITIES, "as_name": v.NAME_ENTITIES,
}


@query("html_entities", "SELECT page_id, " + ", ".join(
    f"md5({k.decode('html', e)}) AS {n}" for n, e in _ENTITY_LISTS.items()) + " FROM pages")
def html_entities(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", *[F.md5(t.decode_entities(F.col("html"), e)).alias(n) for n, e in _ENTITY_LISTS.items()]
    )


@query("title_outlet_split", """
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' - ' || p_type || ' - ' || p_brand
  WHEN 1 THEN p_name || '_ ' || p_type WHEN 2 THEN p_name || '_ ' || p_brand ELSE p_name END AS full_title,
  CASE WHEN p_partkey % 8 = 3 THEN '' ELSE p_brand END AS tag FROM part),
s AS (SELECT *, contains(full_title, ' - ') AS dash,
  contains(full_title, '_ ') AND regexp_matches(string_split(full_title, '_ ')[-1], '^[一-龥A-Za-z0-9·（）()]{2,24}\\z') AS bar FROM p)
SELECT p_partkey,
  CASE WHEN dash THEN array_to_string(string_split(full_title, ' - ')[:-2], ' - ')
       WHEN bar THEN array_to_string(string_split(full_title, '_ ')[:-2], '_ ') ELSE full_title END AS title,
  CASE WHEN dash THEN string_split(full_title, ' - ')[-1] WHEN bar THEN string_split(full_title, '_ ')[-1]
       WHEN tag <> '' THEN tag ELSE '未知来源' END AS media FROM s""")
def title_outlet_split(spark, sf):
    name, kind, brand, n = F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_partkey") % 4
    title = (
        F.when(n == 0, F.concat_ws(" - ", name, kind, brand))
        .when(n == 1, F.concat_ws("_ ", name, kind))
        .when(n == 2, F.concat_ws("_ ", name, brand))
        .otherwise(name)
    )
    tag = F.when(F.col("p_partkey") % 8 == 3, "").otherwise(brand)
    return (
        table(spark, sf, "part")
        .select("p_partkey", t.split_title_outlet(title, tag).alias("s"))
        .select("p_partkey", "s.*")
    )


@query("unicode_escapes", """
SELECT doc_id, md5('来' || text || '源' || '😀') AS decoded, md5(text) AS plain FROM documents""")
def unicode_escapes(spark, sf):
    escaped = F.concat(F.lit("\\u6765"), F.col("text"), F.lit("\\u6E90\\ud83d\\ude00"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(t.unescape_unicode(escaped)).alias("decoded"), F.md5(t.unescape_unicode(F.col("text"))).alias("plain")
    )


@query("name_clean", f"""SELECT doc_id, {k.clean_name("'：、 ' || text || '&amp;' || chr(10) || source || ' ，。'")} AS name FROM documents""")
def name_clean(spark, sf):
    raw = F.concat(F.lit("：、 "), F.col("text"), F.lit("&amp;\n"), F.col("source"), F.lit(" ，。"))
    return table(spark, sf, "documents").select("doc_id", t.clean_outlet(raw).alias("name"))


@query("truncations", "SELECT doc_id, " + ", ".join(f"substr(text, 1, {n}) AS first_{n}" for n in (100, 120, 150, 200)) + " FROM documents")
def truncations(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[t.truncate(F.col("text"), n).alias(f"first_{n}") for n in (100, 120, 150, 200)]
    )


_TAILS = "CASE page_id % 5 WHEN 0 THEN ' - 中国之声' WHEN 1 THEN '_新华网站' WHEN 2 THEN '—晚报 - ' WHEN 3 THEN ' | 搜狐新闻' ELSE '_第3版 - x|建筑时报' END"


def _sql_title_tail(title: str) -> str:
    """Last separator not at the start, per separator, first plausible name."""
    def tail(s: str) -> str:
        parts = f"string_split({title}, {quote(s)})"
        suffix = k.trim(f"{parts}[-1]")
        ok = f"len({parts}) > 1 AND NOT (len({parts}) = 2 AND {parts}[1] = '') AND {k.plausible(suffix)}"
        return f"CASE WHEN {ok} THEN {suffix} END"
    return "COALESCE(" + ", ".join(tail(s) for s in (" - ", "_", "—", "|")) + ")"


@query("title_tail_outlet", f"""
WITH p AS (SELECT page_id, {k.clean_name(f"regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) || ({_TAILS})")} AS title FROM pages)
SELECT page_id, COALESCE({_sql_title_tail('title')}, '') AS outlet FROM p""")
def title_tail_outlet(spark, sf):
    title = F.concat(F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1), F.expr(_TAILS))
    return table(spark, sf, "pages").select("page_id", F.coalesce(t.title_tail_outlet(title), F.lit("")).alias("outlet"))


# one kind of outlet mark per page, in turn; kinds 8 and 9 put a weaker mark before a stronger one
_MARKS = """CASE page_id % 10
  WHEN 0 THEN '<meta name="mediaid" content="新华日报"/>'
  WHEN 1 THEN '<div data-testid="x author-name"> 北京晚报 </div>'
  WHEN 2 THEN '<span class="author-name big">建筑时报</span>'
  WHEN 3 THEN '<script>var nickname = htmlDecode("工人之家");</script>'
  WHEN 4 THEN '<script>{"nickname": "交通之声"}</script>'
  WHEN 5 THEN '<p>来源：<i>审核</i></p><p>来源: <b>呼和浩</b><b>特新闻</b> 责任编辑</p>'
  WHEN 6 THEN '<meta property="og:site_name" content="光明在线"/>'
  WHEN 7 THEN '<p>来源：\\u65b0\\u534e\\u7f51\\u7ad9 2024</p>'
  WHEN 8 THEN '<meta name="source" content="经济之声"/><p>来源：甲报、乙日报，丙新闻网；编辑</p>'
  ELSE '<meta name="mediaid" content="第3频道"/><meta name="source" content="搜狐新闻"/>' END"""
_EXPECTED = """CASE page_id % 10 WHEN 0 THEN '新华日报' WHEN 1 THEN '北京晚报' WHEN 2 THEN '建筑时报' WHEN 3 THEN '工人之家'
  WHEN 4 THEN '交通之声' WHEN 5 THEN '呼和浩特新闻' WHEN 6 THEN '光明在线' WHEN 7 THEN '新华网站' WHEN 8 THEN '丙新闻网' ELSE '' END"""


@query("page_outlet", f"SELECT page_id, {_EXPECTED} AS outlet, CASE page_id % 10 WHEN 9 THEN '搜狐新闻' ELSE {_EXPECTED} END AS outlet_or_platform FROM pages")
def page_outlet(spark, sf):
    # the SQL text and the Spark parser read backslashes differently: build the marked page by column
    marks = F.expr(_MARKS.replace("\\", "\\\\"))
    page = F.concat(marks, F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id",
        F.coalesce(t.outlet_from_page(page), F.lit("")).alias("outlet"),
        F.coalesce(t.outlet_from_page(page, True), F.lit("")).alias("outlet_or_platform"),
    )


@query("source_label", "SELECT page_id, regexp_extract(html, '<footer>&copy; ([^ ]+) ', 1) AS label FROM pages")
def source_label(spark, sf):
    label = F.regexp_extract(F.col("html"), "<footer>&copy; ([^ ]+) ", 1)
    return table(spark, sf, "pages").select("page_id", label.alias("label"))


@query("outlet_names", f"""SELECT ord, media, {k.unreliable('media')} AS unreliable, {k.plausible('media')} AS plausible,
  {k.plausible('media', 'true')} AS plausible_platform, {k.unreliable('title')} AS title_unreliable FROM {ARTICLES_SQL}""")
def outlet_names(spark, sf):
    media = F.col("media")
    return articles(spark, sf).select(
        "ord", "media",
        t.is_unreliable_outlet(media).alias("unreliable"),
        t.is_plausible_outlet(media).alias("plausible"),
        t.is_plausible_outlet(media, True).alias("plausible_platform"),
        t.is_unreliable_outlet(F.col("title")).alias("title_unreliable"),
    )


_ORGS = "CASE c_custkey % 4 WHEN 0 THEN concat(c_name, '建筑集团有限公司') WHEN 1 THEN concat(' ', c_mktsegment, '有限责任公司') WHEN 2 THEN '集团' ELSE c_name END"


@query("organisation_variants", f"""
WITH c AS (SELECT c_custkey, {k.trim(_ORGS)} AS base FROM customer),
s AS (SELECT *, {k.trim("regexp_replace(base, '有限公司|股份有限公司|集团有限公司|集团|有限责任公司', '', 'g')")} AS short FROM c)
SELECT c_custkey, base || CASE WHEN length(base) > 4 AND short <> base AND length(short) >= 2 THEN '|' || short ELSE '' END AS variants,
  '"' || base || '"' AS quoted FROM s""")
def organisation_variants(spark, sf):
    name = F.expr(_ORGS)
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.array_join(t.organisation_variants(name), "|").alias("variants"),
        F.element_at(t.organisation_variants(name, quoted=True), 1).alias("quoted"),
    )


# --- links --------------------------------------------------------------------------------------------

# every page under the link it has and under two disguises of it
_LINKS = """SELECT page_id, 0 AS copy, url FROM {pages} UNION ALL
  SELECT page_id, 1 AS copy, replace(replace(url, '://', '://www.'), '://www.www.', '://www.') FROM {pages} UNION ALL
  SELECT page_id, 2 AS copy, concat(replace(url, '#top', ''), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'spm=a.b&from=', page_id) FROM {pages}"""
_LINKS_SQL = "(" + _LINKS.replace("{pages}", "pages") + ")"


def links(spark, sf):
    return spark.sql(_LINKS, pages=table(spark, sf, "pages"))


@query("url_canonical", f"SELECT page_id, copy, {k.canonical('url')} AS url_key, substr({k.canonical('url')}, 1, 150) AS dedup_key FROM {_LINKS_SQL}")
def url_canonical(spark, sf):
    return links(spark, sf).select(
        "page_id", "copy", urls.canonical_url(F.col("url")).alias("url_key"), urls.dedup_url(F.col("url"), 150).alias("dedup_key")
    )


@query("url_parts", f"""SELECT ord, {k.host('url')} AS host, {k.first_pair(k.site('url'), v.HOST_SHORT_NAMES, k.site('url'))} AS short_name,
  regexp_matches(url, '(?i)^https?://') AS is_http, contains(url, 'news.google.com') AS is_redirect,
  regexp_extract(url, '/articles/([^?]+)', 1) AS redirect_id FROM {ARTICLES_SQL}""")
def url_parts(spark, sf):
    u = F.col("url")
    return articles(spark, sf).select(
        "ord", urls.host(u).alias("host"), short_outlet(u).alias("short_name"), urls.is_http(u).alias("is_http"),
        urls.is_redirect(u).alias("is_redirect"), urls.redirect_id(u).alias("redirect_id"),
    )


# --- dates --------------------------------------------------------------------------------------------

_DATE_TEXT = """CASE event_id % 9 WHEN 0 THEN '今天' WHEN 1 THEN '昨天' WHEN 2 THEN '前天' WHEN 3 THEN concat({n}, '天前')
  WHEN 4 THEN concat({n}, ' 小时前') WHEN 5 THEN concat('发布于', {n}, '分钟前') WHEN 6 THEN concat({n} % 12 + 1, '月', {n} % 28 + 1, '日')
  WHEN 7 THEN concat('2023-', {n} % 12 + 1, '-', {n} % 28 + 1) ELSE event_type END"""
_SQL_N = "(event_id * 7 % 5000)"


@query("relative_dates", f"""
SELECT event_id, CASE event_id % 9 WHEN 0 THEN strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%d')
  WHEN 1 THEN strftime(TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY, '%Y-%m-%d')
  WHEN 2 THEN strftime(TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY, '%Y-%m-%d')
  WHEN 3 THEN strftime(TIMESTAMP '{AS_OF}' - to_days({_SQL_N}::INTEGER), '%Y-%m-%d')
  WHEN 4 THEN strftime(TIMESTAMP '{AS_OF}' - to_hours({_SQL_N}), '%Y-%m-%d')
  WHEN 5 THEN strftime(TIMESTAMP '{AS_OF}' - to_minutes({_SQL_N}), '%Y-%m-%d')
  WHEN 6 THEN '2024-' || lpad(({_SQL_N} % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad(({_SQL_N} % 28 + 1)::VARCHAR, 2, '0')
  WHEN 7 THEN '2023-' || lpad(({_SQL_N} % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad(({_SQL_N} % 28 + 1)::VARCHAR, 2, '0')
  ELSE event_type END AS day FROM events""")
def relative_dates(spark, sf):
    said = F.expr(_DATE_TEXT.replace("{n}", _SQL_N))
    return table(spark, sf, "events").select("event_id", dates.normalise_date(said, AS_OF).alias("day"))


@query("epoch_days", """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 999999999 WHEN 2 THEN 2000000001 + event_id
  ELSE epoch(date_trunc('second', ts))::BIGINT END AS s FROM events)
SELECT event_id, CASE WHEN s < 1000000000 THEN '' ELSE strftime(make_timestamp(s * 1000000), '%Y-%m-%d') END AS api_day,
  CASE WHEN s < 1000000000 OR s > 2000000000 THEN '' ELSE strftime(make_timestamp(s * 1000000), '%Y-%m-%d') END AS page_day FROM e""")
def epoch_days(spark, sf):
    n = F.col("event_id") % 5
    s = F.when(n == 0, 0).when(n == 1, 999_999_999).when(n == 2, F.lit(2_000_000_001) + F.col("event_id")).otherwise(
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    )
    return table(spark, sf, "events").select(
        "event_id", dates.epoch_day(s).alias("api_day"), dates.epoch_day(s, 2_000_000_000).alias("page_day")
    )


@query("mail_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN o_orderpriority
  WHEN o_orderkey % 7 IN (1, 4) THEN strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS rss_day,
  CASE WHEN o_orderkey % 7 = 6 THEN o_orderpriority WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%d')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS api_day FROM orders""")
def mail_dates(spark, sf):
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 7
    said = (
        F.when(n == 0, F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(n == 1, F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss '+0800'"))
        .when(n == 2, F.date_format(d, "d MMM yyyy"))
        .when(n == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'.0000000Z'"))
        .when(n == 4, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"))
        .when(n == 5, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.mail_date_day(said).alias("rss_day"), dates.api_date_day(said).alias("api_day")
    )


@query("range_instants", f"""
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, event_id % 3 = 0 AS bad FROM events)
SELECT event_id, CASE WHEN bad THEN epoch(TIMESTAMP '{AS_OF}')::BIGINT - 365 * 86400 ELSE epoch(d::TIMESTAMP)::BIGINT - 28800 END AS "start",
  least(epoch(d::TIMESTAMP)::BIGINT + 86399 - 28800, epoch(TIMESTAMP '{AS_OF}')::BIGINT) AS "end" FROM e""")
def range_instants(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    bounds = dates.range_instants(F.when(F.col("event_id") % 3 == 0, "?").otherwise(day), day, AS_OF)
    return table(spark, sf, "events").select("event_id", bounds.alias("b")).select("event_id", "b.*")


_ASKED_FROM = "CASE WHEN l_quantity = 1 THEN '' WHEN l_quantity = 2 THEN NULL WHEN l_linenumber = 7 THEN '2024-02-30' ELSE {ship} END"
_ASKED_TO = "CASE WHEN l_quantity = 3 THEN NULL WHEN l_quantity = 4 THEN 'tomorrow' ELSE {ordered} END"


@query("range_check", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_ASKED_FROM.format(ship="strftime(l_shipdate, '%Y-%m-%d')")} AS f,
    {_ASKED_TO.format(ordered="strftime(o_orderdate + INTERVAL 60 DAY, '%Y-%m-%d')")} AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN f IS NULL OR t IS NULL OR f = '' OR t = '' THEN 'missing' WHEN try_cast(f AS DATE) IS NULL OR try_cast(t AS DATE) IS NULL THEN 'not_a_date'
  WHEN try_cast(f AS DATE) > try_cast(t AS DATE) THEN 'starts_after_end' END AS reason FROM r""")
def range_check(spark, sf):
    """Ranges asked from the day of shipping to two months after the order, some of them broken."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = lines.select("l_orderkey", "l_linenumber", F.expr(_ASKED_FROM.format(ship="date_format(l_shipdate, 'yyyy-MM-dd')")).alias("f"),
                         F.expr(_ASKED_TO.format(ordered="date_format(o_orderdate + INTERVAL 60 DAY, 'yyyy-MM-dd')")).alias("t"))
    return asked.select("l_orderkey", "l_linenumber", dates.range_reason(F.col("f"), F.col("t")).alias("reason"))


@query("recency", """
WITH o AS (SELECT o_orderkey, date_diff('second', o_orderdate - INTERVAL 8 HOUR, TIMESTAMP '1998-12-01 00:00:00') / 86400.0 AS span,
  date_diff('day', o_orderdate, TIMESTAMP '1998-12-01 00:00:00') AS days FROM orders)
SELECT o_orderkey, CASE WHEN greatest(span, 0) <= 7 THEN '7d' WHEN span <= 30 THEN '30d' WHEN span <= 90 THEN '90d' WHEN span <= 365 THEN '1y' ELSE '' END AS news,
  CASE WHEN span <= 1 THEN 'day' WHEN span <= 7 THEN 'week' WHEN span <= 180 THEN 'half_year' ELSE 'all' END AS wechat,
  CASE WHEN days <= 1 THEN 'Day' WHEN days <= 7 THEN 'Week' ELSE 'Month' END AS api FROM o""")
def recency(spark, sf):
    as_of = "1998-12-01T00:00:00"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.news_recency(day, as_of).alias("news"),
        dates.wechat_recency(day, as_of).alias("wechat"),
        dates.api_freshness(F.datediff(F.lit("1998-12-01"), "o_orderdate")).alias("api"),
    )
