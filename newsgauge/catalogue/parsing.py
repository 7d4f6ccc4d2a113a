"""Payload parsers. The payloads are built from the documents' lines, in the landed formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.catalogue import checks as k
from newsgauge.catalogue.deduping import merge_sql
from newsgauge.catalogue.registry import ORACLE, query, table
from newsgauge.catalogue.views import ARTICLES_SQL, AS_OF, articles, quote
from newsgauge.operators.report import source_counts
from newsgauge.plans.search import request_articles as build_request
from newsgauge.sources import payloads as p

_FIELDS = ("title", "url", "date", "media", "snippet")
_LINES_SQL = """lines AS (SELECT doc_id, source, lang, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _per_line(item: str, joiner: str = "") -> str:
    """SQL that builds a payload body from one expression per line; x is the line, i its number."""
    return f"array_join(transform(split(text, '\\n'), (x, i) -> {item}), '{joiner}')"


def _rows(df):
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), *_FIELDS)


# --- RSS ----------------------------------------------------------------------------------------------

_RSS_ITEM = """concat('<ITEM><title><![CDATA[', x, CASE i % 4 WHEN 0 THEN concat(' - ', source) WHEN 1 THEN concat('_ ', upper(source)) WHEN 2 THEN ' &amp;lt;' ELSE '' END,
  ']]></title><link> https://', lang, '.example.com/', doc_id, '/', i, '\n</link><pubDate>', CASE i % 3 WHEN 0 THEN concat('Mon, ', i % 28 + 1, ' Mar 2024 04:00:00 +0800')
  WHEN 1 THEN concat(i % 28 + 1, ' Apr 2024 10:00:00 GMT') ELSE 'soon' END, '</pubDate><source url="u">', CASE WHEN i % 8 = 3 THEN '' ELSE lang END,
  '</source><description><![CDATA[<b>', x, '</b> &lt;&amp;gt; ]]></description></ITEM>')"""


def rss_payloads(spark, sf):
    return _docs(spark, sf).select("doc_id", F.expr(f"concat('<rss>', {_per_line(_RSS_ITEM)}, '</rss>')").alias("body"))


_SPLIT_TITLE = """CASE WHEN contains(t, ' - ') AND strpos(t, ' - ') > 0 AND NOT (len(string_split(t, ' - ')) = 2 AND starts_with(t, ' - ')) THEN 'dash'
  WHEN contains(t, '_ ') AND regexp_matches(trim(string_split(t, '_ ')[-1]), '^[一-龥A-Za-z0-9·（）()]{2,24}\\z') THEN 'bar' ELSE '' END"""


@query("rss_parse", f"""
WITH {_LINES_SQL},
t AS (SELECT *, {k.trim(k.decode("line || CASE i % 4 WHEN 0 THEN ' - ' || source WHEN 1 THEN '_ ' || upper(source) WHEN 2 THEN ' &amp;lt;' ELSE '' END", v.RSS_TITLE_ENTITIES))} AS t FROM lines),
s AS (SELECT *, {_SPLIT_TITLE} AS how, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM t WHERE length(t) >= 4)
SELECT doc_id, pos, CASE how WHEN 'dash' THEN trim(array_to_string(string_split(t, ' - ')[:-2], ' - ')) WHEN 'bar' THEN trim(array_to_string(string_split(t, '_ ')[:-2], '_ ')) ELSE t END AS title,
  'https://' || lang || '.example.com/' || doc_id || '/' || i AS url,
  CASE i % 3 WHEN 0 THEN strftime(make_timestamp(2024, 3, (i % 28 + 1)::INTEGER, 4, 0, 0.0) - INTERVAL 8 HOUR, '%Y-%m-%d') WHEN 1 THEN '2024-04-' || lpad((i % 28 + 1)::VARCHAR, 2, '0') ELSE 'soon' END AS date,
  CASE how WHEN 'dash' THEN trim(string_split(t, ' - ')[-1]) WHEN 'bar' THEN trim(string_split(t, '_ ')[-1]) ELSE CASE WHEN i % 8 = 3 THEN '未知来源' ELSE lang END END AS media,
  substr({k.trim(k.decode("line || ' &lt;&amp;gt; '", v.RSS_SNIPPET_ENTITIES))}, 1, 200) AS snippet FROM s""")
def rss_parse(spark, sf):
    return _rows(p.parse_rss(rss_payloads(spark, sf)))


# --- result list HTML -----------------------------------------------------------------------------------

_H3 = '<h3 class="news-title_1">'
_NEWS_ITEM = f"""concat('{_H3}<a href="https://', lang, '.example.com/', doc_id, '/', i, '" target="_blank"> <em>', x, '</em></a></h3><div>about ', x, '</div><div class="news-source_x">',
  CASE i % 3 WHEN 0 THEN concat('<span aria-label="新闻来源：', source, '">s</span>') WHEN 1 THEN concat('<a class="source-link_y" href="https://www.', CASE i % 2 WHEN 0 THEN 'finance.sina.com.cn' ELSE 'unknown.example' END, '/x">s</a>') ELSE '' END,
  CASE i % 5 WHEN 0 THEN '<span aria-label="发布于：2024-1-5">d</span>' WHEN 1 THEN concat('<span>', i + 1, ' 天前</span>') WHEN 2 THEN concat('<i>', i, '小时前</i>') WHEN 3 THEN '<i>8月2日</i>' ELSE '' END, '</div>')"""


def news_payloads(spark, sf):
    return _docs(spark, sf).select("doc_id", F.expr(f"concat('<html>', {_per_line(_NEWS_ITEM)}, '</html>')").alias("body"))


_NEWS_BODY_SQL = "'<html>' || array_to_string(list(" + _NEWS_ITEM.replace("x,", "line,").replace("x, '</div>", "line, '</div>") + " ORDER BY i), '') || '</html>'"


def _news_sql(window: str) -> str:
    """Check SQL of the parsed results, each read from ``window``: parts are the page's texts between headlines, j is its number."""
    return f"""
WITH {_LINES_SQL}, b AS (SELECT doc_id, {_NEWS_BODY_SQL} AS body FROM lines GROUP BY doc_id),
p AS (SELECT doc_id, string_split(body, '{_H3}') AS parts FROM b),
w AS (SELECT doc_id, j, {window} AS w FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS j FROM p)),
t AS (SELECT *, {k.trim(k.strip_tags(f"regexp_extract(w, '(?s){_H3}<a href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2)"))} AS title FROM w),
k AS (SELECT *, CASE WHEN contains(w, 'news-source') THEN substr(w, strpos(w, 'news-source'), 900) ELSE '' END AS line, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS pos FROM t WHERE length(title) >= 4),
d AS (SELECT *, COALESCE(nullif(regexp_extract(w, 'aria-label="发布于：([^"]*)"', 1), ''), nullif(regexp_extract(line, '([0-9]+ *天前)', 1), ''),
  nullif(regexp_extract(line, '([0-9]+ *小时前)', 1), ''), nullif(regexp_extract(line, '([0-9]+月[0-9]+日)', 1), ''), '') AS said,
  regexp_extract(w, '<a[^>]*class="[^"]*source-link[^"]*"[^>]*href="([^"]*)"', 1) AS link FROM k)
SELECT doc_id, pos, title, regexp_extract(w, '<a href="([^"]*)"', 1) AS url,
  CASE WHEN said = '2024-1-5' THEN '2024-01-05' WHEN contains(said, '天前') THEN strftime(TIMESTAMP '{AS_OF}' - to_days(regexp_extract(said, '[0-9]+')::INTEGER), '%Y-%m-%d')
    WHEN contains(said, '小时前') THEN strftime(TIMESTAMP '{AS_OF}' - to_hours(regexp_extract(said, '[0-9]+')::BIGINT), '%Y-%m-%d') WHEN said = '8月2日' THEN '2024-08-02' ELSE said END AS date,
  COALESCE(nullif(regexp_extract(w, 'aria-label="新闻来源：([^"]*)"', 1), ''), nullif({k.first_pair(k.site('link'), v.HOST_SHORT_NAMES, k.site('link'))}, ''), '未知来源') AS media,
  substr({k.trim("replace(" + k.squeeze(k.strip_tags('w', ' ')) + ", title, '')")}, 1, 200) AS snippet FROM d"""


@query("news_html_parse", _news_sql(f"substr('{_H3}' || array_to_string(parts[j:j + 12], '{_H3}'), 1, 1500)"))
def news_html_parse(spark, sf):
    return _rows(p.parse_news_html(news_payloads(spark, sf), AS_OF))


@query("news_html_whole", _news_sql(f"'{_H3}' || parts[j]"))
def news_html_whole(spark, sf):
    """Each result from its headline to the next one, however long."""
    return _rows(p.parse_news_html(news_payloads(spark, sf), AS_OF, whole=True))


# --- account result HTML --------------------------------------------------------------------------------

_BLOCK = """concat('<div class="txt-box"><h3><a target="_blank" href="/link?url=', doc_id, '-', i, '">', x, '</a></h3><p class="txt-info"><span>document.write(1)</span><span>',
  CASE i % 3 WHEN 0 THEN source ELSE '' END, '</span></p><p class="p s-p x">', x, ' &hellip; &amp;nbsp;</p>',
  CASE WHEN i % 4 = 3 THEN '' ELSE concat('<script>document.write(timeConvert(''', CAST(1700000000 + 86400 * i AS STRING), '''))</script>') END, '</div>')"""


def wechat_payloads(spark, sf):
    return _docs(spark, sf).select("doc_id", F.expr(f"concat('<html>', {_per_line(_BLOCK)}, '</html>')").alias("body"))


@query("wechat_html_parse", f"""
WITH {_LINES_SQL}, e AS (SELECT doc_id, list(1700000000 + 86400 * i ORDER BY i) FILTER (WHERE i % 4 <> 3) AS marks FROM lines GROUP BY doc_id),
t AS (SELECT l.*, e.marks, {k.decode(k.trim(k.strip_tags('line')), v.WECHAT_ENTITIES)} AS title FROM lines l JOIN e USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM t WHERE length(title) >= 4)
SELECT doc_id, pos, title, 'https://weixin.sogou.com/link?url=' || doc_id || '-' || i AS url,
  COALESCE(strftime(make_timestamp(CASE WHEN i % 4 <> 3 THEN 1700000000 + 86400 * i ELSE marks[pos + 1] END * 1000000), '%Y-%m-%d'), '') AS date,
  CASE i % 3 WHEN 0 THEN source ELSE '微信公众号' END AS media,
  substr({k.decode(k.trim(k.strip_tags("line || ' &hellip; &amp;nbsp;'")), v.WECHAT_ENTITIES)}, 1, 200) AS snippet FROM k""")
def wechat_html_parse(spark, sf):
    return _rows(p.parse_wechat_html(wechat_payloads(spark, sf)))


# --- JSON -------------------------------------------------------------------------------------------------

_API_ITEM = """named_struct('title', concat('<em class="h">', x, '</em>', CASE WHEN i % 2 = 0 THEN ' &amp;lt;' ELSE '' END), 'doc_url', CASE WHEN i % 5 = 4 THEN '' ELSE concat('https://a.example/', doc_id, '/', i) END,
  'timestamp', CASE WHEN i % 3 = 2 THEN 5 ELSE 1700000000 + 86400 * i END, 'source', named_struct('title', CASE WHEN i % 2 = 0 THEN source END), 'desc', concat(x, '<br>&ldquo;'))"""


def api_payloads(spark, sf):
    items = f"transform(split(text, '\\n'), (x, i) -> {_API_ITEM})"
    body = f"to_json(named_struct('data', named_struct('results', named_struct('data', array(named_struct('items', {items}))))))"
    return _docs(spark, sf).select("doc_id", F.expr(body).alias("body"))


@query("wechat_api_parse", f"""
WITH {_LINES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM lines WHERE i % 5 <> 4)
SELECT doc_id, pos, {k.trim(k.decode(k.strip_tags("line || CASE WHEN i % 2 = 0 THEN ' &amp;lt;' ELSE '' END"), v.API_ENTITIES))} AS title, 'https://a.example/' || doc_id || '/' || i AS url,
  CASE WHEN i % 3 = 2 THEN '' ELSE strftime(make_timestamp((1700000000 + 86400 * i) * 1000000), '%Y-%m-%d') END AS date,
  CASE WHEN i % 2 = 0 THEN source ELSE '微信公众号' END AS media, substr({k.trim(k.decode(k.strip_tags("line || '<br>&ldquo;'"), v.API_ENTITIES))}, 1, 200) AS snippet FROM t""")
def wechat_api_parse(spark, sf):
    return _rows(p.parse_wechat_api(api_payloads(spark, sf)))


_NEWS_API_ITEM = """named_struct('name', CASE WHEN i % 4 = 3 THEN '' ELSE x END, 'url', concat('https://www.', lang, '.example/', doc_id, '/', i),
  'datePublished', concat('2024-05-0', i % 9 + 1, 'T10:00:00.0000000Z'), 'description', x,
  'provider', CASE WHEN i % 3 = 0 THEN array(named_struct('name', source)) END, 'image', named_struct('thumbnail', named_struct('contentUrl', concat('https://i/', i))))"""


def news_api_payloads(spark, sf):
    items = f"transform(split(text, '\\n'), (x, i) -> {_NEWS_API_ITEM})"
    return _docs(spark, sf).select("doc_id", F.expr(f"to_json(named_struct('value', {items}))").alias("body"))


@query("news_api_parse", f"""
WITH {_LINES_SQL} SELECT doc_id, i AS pos, CASE WHEN i % 4 = 3 OR line = '' THEN '无标题' ELSE line END AS title, 'https://www.' || lang || '.example/' || doc_id || '/' || i AS url,
  '2024-05-0' || (i % 9 + 1) AS date, CASE WHEN i % 3 = 0 THEN source ELSE lang || '.example' END AS media, line AS snippet, 'https://i/' || i AS image_url FROM lines""")
def news_api_parse(spark, sf):
    rows = p.parse_news_api(news_api_payloads(spark, sf))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), *_FIELDS, "image_url")


# --- guards and unions --------------------------------------------------------------------------------------

_GUARDS = ((200, None, None), (2000, "cheap-pills|antispider", None), (1000, "Released|License", 3000))


def _guard_sql(n, pattern, head):
    text = "html" if head is None else f"substr(html, 1, {head})"
    challenge = "" if pattern is None else f" WHEN regexp_matches({text}, {quote(pattern)}) THEN 'challenge'"
    return f"CASE WHEN length(html) < {n} THEN 'too_short'{challenge} ELSE '' END"


@query("payload_guards", "SELECT page_id, " + ", ".join(f"{_guard_sql(*g)} AS guard{i}" for i, g in enumerate(_GUARDS)) + " FROM pages")
def payload_guards(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        *[F.coalesce(p.block_reason(F.col("html"), *g), F.lit("")).alias(f"guard{i}") for i, g in enumerate(_GUARDS)],
    )


@query("quarantined_pages", f"SELECT page_id, url, {_guard_sql(2000, 'spam', 3000)} AS block_reason FROM pages WHERE {_guard_sql(2000, 'spam', 3000)} <> ''")
def quarantined_pages(spark, sf):
    pages = table(spark, sf, "pages")
    return p.quarantine(pages, p.block_reason(F.col("html"), 2000, "spam", 3000))[1].select("page_id", "url", "block_reason")


_UNION_SQL = "(SELECT doc_id AS id, text, 'news' AS source FROM documents UNION ALL SELECT conv_id * 1000 + turn, text, 'wechat' FROM conversations)"


def _union(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    talks = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return p.union_engines(news=docs, wechat=talks)


@query("engine_union", f"SELECT id, source, md5(text) AS h FROM {_UNION_SQL}")
def engine_union(spark, sf):
    return _union(spark, sf).select("id", "source", F.md5("text").alias("h"))


@query("engine_counts", f"SELECT count(*) FILTER (WHERE source = 'news') AS news, count(*) FILTER (WHERE source <> 'news') AS wechat FROM {_UNION_SQL}")
def engine_counts(spark, sf):
    return source_counts(_union(spark, sf))


@query("engine_mode", f"SELECT ord, source FROM {ARTICLES_SQL} WHERE source = 'wechat'")
def engine_mode(spark, sf):
    return p.choose_engines(articles(spark, sf), "wechat").select("ord", "source")


@query("json_payload", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_payload(spark, sf):
    parsed = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", parsed.alias("k"))


def page_of(doc_id):
    """The result page a document stands for, as a LONG: later documents never come on earlier pages."""
    return F.floor(doc_id / 60).cast("bigint")


def _landed_sql(limited: bool) -> str:
    """The rows of all engines as the checking engine parses them, merged per keyword, perhaps cut, and numbered."""
    pages = """(SELECT doc_id, source AS keyword, regexp_extract(source, '[0-9]+')::INT AS keyword_rank, doc_id % 3 AS q, doc_id // 60 AS page_no FROM documents)"""
    short = {"rss": (_RSS_ITEM, "<rss></rss>", 200, ""), "wechat_html": (_BLOCK, "<html></html>", 1000, "OR bool_or(regexp_matches(line, '请输入验证码|antispider'))")}
    out = []
    for engine, (parsed, rank) in {"news_html": ("news_html_parse", 0), "rss": ("rss_parse", 1), "news_api": ("news_api_parse", 2),
                                   "wechat_api": ("wechat_api_parse", 0), "wechat_html": ("wechat_html_parse", 1)}.items():
        usable = ""
        if engine in short:
            item, frame, least, challenge = short[engine]
            usable = (f" WHERE doc_id NOT IN (WITH {_LINES_SQL} SELECT doc_id FROM lines GROUP BY doc_id HAVING "
                      f"sum(length({item.replace(' x, ', ' line, ')})) + {len(frame)} < {least} {challenge})")
        out.append(f"SELECT '{engine}' AS engine, {rank} AS e, doc_id, pos, title, url, date, media, snippet FROM ({ORACLE[parsed]}){usable}")
    every = f"(SELECT r.*, p.* EXCLUDE (doc_id), row_number() OVER (ORDER BY page_no, doc_id, pos) AS ord FROM ({' UNION ALL '.join(out)}) r JOIN {pages} p USING (doc_id))"
    news = "(SELECT * FROM every WHERE engine IN ('news_html', 'rss', 'news_api'))"
    key = k.canonical("url")
    merged = merge_sql(news, f"substr({key}, 1, 150)", v.MAX_PER_QUERY, v.MAX_NEWS_PER_SUBJECT) if limited else merge_sql(news, key)
    return merged.replace("WITH a AS", f"WITH every AS MATERIALIZED {every}, a AS", 1) + f""",
n AS (SELECT keyword, 0 AS kind, generate_subscripts(ls, 1) AS place, unnest(list_transform(ls, lambda l: l.r.c)) AS ord FROM m2),
once AS (SELECT *, row_number() OVER (PARTITION BY keyword, url ORDER BY e, q, ord) AS rl FROM every WHERE engine IN ('wechat_api', 'wechat_html')),
twice AS (SELECT *, row_number() OVER (PARTITION BY keyword, {k.trim('title')} ORDER BY e, q, ord) AS rt FROM once WHERE rl = 1),
w AS (SELECT keyword, 1 AS kind, row_number() OVER (PARTITION BY keyword ORDER BY e, q, ord) AS place, e, ord FROM twice WHERE rt = 1{f" QUALIFY place <= {v.MAX_WECHAT_PER_SUBJECT}" if limited else ""}),
both_ AS (SELECT x.*, t.keyword_rank, t.title, t.url, t.date, t.media, t.snippet FROM n x JOIN every t ON t.ord = x.ord AND t.engine IN ('news_html', 'rss', 'news_api')
  JOIN u1 ON u1.keyword = x.keyword AND u1.item.r.b = x.ord AND u1.item.r.a = t.e AND u1.item.r.title = t.title
  UNION ALL SELECT w.keyword, kind, place, w.ord, t.keyword_rank, t.title, t.url, t.date, t.media, t.snippet FROM w JOIN every t ON t.ord = w.ord AND t.e = w.e AND t.engine IN ('wechat_api', 'wechat_html'))
SELECT row_number() OVER (ORDER BY keyword_rank, keyword, kind, place) AS ord, keyword, CASE kind WHEN 0 THEN 'news' ELSE 'wechat' END AS source, title, url, date, media, snippet FROM both_"""


def _landed(spark, sf):
    """Each document as one result page of each engine for its source, fetched in order."""
    docs = {
        "news_html": news_payloads, "rss": rss_payloads, "news_api": news_api_payloads,
        "wechat_api": api_payloads, "wechat_html": wechat_payloads,
    }
    where = _docs(spark, sf).select(
        "doc_id",
        F.col("source").alias("keyword"),
        F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("keyword_rank"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("query_rank"),
        page_of(F.col("doc_id")).alias("page_no"),
        F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("fetched_at"),
    )
    parts = [make(spark, sf).withColumn("engine", F.lit(engine)) for engine, make in docs.items()]
    bodies = parts[0]
    for other in parts[1:]:
        bodies = bodies.unionByName(other)
    return bodies.join(where, "doc_id").drop("doc_id")


@query("landed_search", _landed_sql(True))
def landed_search(spark, sf):
    """All five engines end to end, with lists of limited length and links compared by their first 150 characters."""
    found = build_request(_landed(spark, sf), AS_OF, max_per_query=v.MAX_PER_QUERY, max_news=v.MAX_NEWS_PER_SUBJECT,
                          max_accounts=v.MAX_WECHAT_PER_SUBJECT, news_link_chars=150)
    return found.select("ord", "keyword", "source", *_FIELDS)


@query("landed_search_whole", _landed_sql(False))
def landed_search_whole(spark, sf):
    """All five engines end to end, with whole lists and links."""
    return build_request(_landed(spark, sf), AS_OF).select("ord", "keyword", "source", *_FIELDS)


@query("landed_rejects", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'unknown_engine' ELSE 'too_short' END AS block_reason
FROM documents WHERE doc_id % 3 = 2 OR (doc_id % 3 = 0 AND length(text) < 200)""")
def landed_rejects(spark, sf):
    """Payloads that no parser reads, with the reason: every text as a page of one of three engines."""
    engine = F.element_at(F.array(F.lit("rss"), F.lit("news_api"), F.lit("telegraph")), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    landed = _docs(spark, sf).select("doc_id", engine.alias("engine"), F.col("text").alias("body"))
    return p.rejected_payloads(landed).select("doc_id", "block_reason")
