"""Parsers from landed payloads to article rows.

Each parser takes a table with a text column ``body`` (one landed response per row) and adds one row
per accepted result: ``pos`` (0-based position on the page), ``title, url, date, media, snippet``.
All work happens inside one row, so a parser is a narrow stage: no shuffle, any number of payloads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions import dates, text as t, urls

ARTICLE_FIELDS = ("title", "url", "date", "media", "snippet")


def _explode(df: DataFrame, articles: Column, body: str, max_results: int | None) -> DataFrame:
    if max_results is not None:
        articles = F.slice(articles, 1, max_results)
    keep = [c for c in df.columns if c != body]
    rows = df.select(*keep, F.posexplode(articles).alias("pos", "_a"))
    return rows.select(*keep, "pos", "_a.*")


def _accepted(parts: Column, fields, max_results: int | None = None) -> Column:
    """Raw fields of each part, found once, for the parts whose title is long enough."""
    found = F.transform(parts, fields)
    found = F.filter(found, lambda r: F.length(r["title"]) >= v.MIN_TITLE_CHARS)
    return found if max_results is None else F.slice(found, 1, max_results)


def _until(tag: str) -> str:
    """Pattern of a group up to the next end of ``tag``, and of that end. Runs without ``<`` are taken at once, and none is given back."""
    end = rf"/(?i:{tag}>)"
    return rf"((?:[^<]++|<(?!{end}))*+)<{end}"


def _inner(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, rf"<(?i:{tag}>){_until(tag.split('[')[0])}", 1)


def parse_rss(df: DataFrame, body: str = "body", max_results: int | None = None) -> DataFrame:
    """``<item>`` elements of an RSS feed; the cap counts accepted items."""

    def fields(item: Column) -> Column:
        title = t.decode_entities(t.strip_cdata(_inner(item, "title")), v.RSS_TITLE_ENTITIES)
        return F.struct(
            t.trim_ws(title).alias("title"),
            _inner(item, "link").alias("link"),
            t.trim_ws(_inner(item, "pubDate")).alias("date"),
            _inner(item, "source[^>]*").alias("source"),
            _inner(item, "description").alias("description"),
        )

    def article(r: Column) -> Column:
        snippet = t.decode_entities(t.strip_tags(t.strip_cdata(r["description"])), v.RSS_SNIPPET_ENTITIES)
        date = dates.mail_date_day(r["date"])
        return t.bind(
            t.split_title_outlet(r["title"], r["source"]),
            lambda split: F.struct(
                split["title"].alias("title"),
                t.trim_ws(r["link"]).alias("url"),
                date.alias("date"),
                split["media"].alias("media"),
                t.truncate(t.trim_ws(snippet), v.SNIPPET_CHARS).alias("snippet"),
            ),
        )

    items = F.regexp_extract_all(F.col(body), F.lit(rf"<(?i:item>){_until('item')}"), F.lit(1))
    return _explode(df, F.transform(_accepted(items, fields, max_results), article), body, None)


def short_outlet(url: Column) -> Column:
    """Short outlet name for a link's host: first known fragment, else the host, else the text."""

    def named(name: Column) -> Column:
        known = reduce(lambda acc, kv: acc.when(F.contains(name, F.lit(kv[0])), kv[1]), v.HOST_SHORT_NAMES, F)
        return F.when(name == "", url).otherwise(known.otherwise(name))

    return t.bind(urls.site(url), named)


_NEWS_H3 = r'<(?i:h3[^>]*class="[^"]*news-title[^"]*"[^>]*>)'


def _label(w: Column, name: str) -> Column:
    """What the first ``aria-label`` says after ``name``; blank if there is none, or no end of it."""
    mark = f'aria-label="{name}：'
    rest = F.substring(w, F.locate(mark, w) + len(mark), F.length(w))
    said = t.bind(rest, lambda x: F.when(F.contains(x, F.lit('"')), F.substring_index(x, '"', 1)).otherwise(""))
    return F.when(F.contains(w, F.lit(mark)), said).otherwise("")


def parse_news_html(df: DataFrame, as_of, body: str = "body", max_results: int | None = None, whole: bool = False) -> DataFrame:
    """Result list HTML: one window per headline, windows may overlap.

    A window has ``v.RESULT_WINDOW_CHARS`` characters from its headline on, whatever follows. With ``whole`` it is the
    result itself, from its headline to the next one or to the end, however long. Patterns are tried only
    where a plain search finds their words.
    """

    ws = t.WS
    anchor = rf'(?is){_NEWS_H3}{ws}*<a[^>]*href="([^"]*)"[^>]*>'
    marks = {"天前": rf"[0-9]+{ws}*天前", "小时前": rf"[0-9]+{ws}*小时前", "分钟前": rf"[0-9]+{ws}*分钟前", "月": "[0-9]{1,2}月[0-9]{1,2}日"}

    def source_line(w: Column) -> Column:
        return F.substring(w, F.locate("news-source", w), F.lit(v.SOURCE_LINE_CHARS))

    def date_on(line: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(line, F.lit(word)), t.blank_to_null(F.regexp_extract(line, f"({m})", 1)))
                            for word, m in marks.items()], F.lit(""))

    def linked_outlet(w: Column) -> Column:
        link = F.regexp_extract(w, '<a[^>]*class="[^"]*source-link[^"]*"[^>]*href="([^"]*)"', 1)
        return F.when(F.contains(w, F.lit("source-link")), t.bind(link, lambda x: F.when(x != "", short_outlet(x))))

    def fields(w: Column) -> Column:
        return F.struct(
            w.alias("window"),
            t.trim_ws(t.strip_tags(F.regexp_extract(w, rf"{anchor}{_until('a')}", 2))).alias("title"),
            _label(w, "新闻来源").alias("media"),
            _label(w, "发布于").alias("date"),
        )

    def article(r: Column) -> Column:
        # without a label the date is looked for only on the source line, never in the summary
        unlabelled = F.when(F.contains(r["window"], F.lit("news-source")), t.bind(source_line(r["window"]), date_on)).otherwise("")
        said = F.when(r["date"] != "", r["date"]).otherwise(unlabelled)
        media = F.when(r["media"] != "", r["media"]).otherwise(linked_outlet(r["window"]))
        summary = F.replace(t.squeeze_ws(t.strip_tags(r["window"], " ")), r["title"], F.lit(""))
        return F.struct(
            r["title"].alias("title"),
            F.regexp_extract(r["window"], anchor, 1).alias("url"),
            t.bind(said, lambda x: dates.normalise_date(x, as_of)).alias("date"),
            F.coalesce(media, F.lit(v.UNKNOWN_OUTLET)).alias("media"),
            t.truncate(t.trim_ws(summary), v.SNIPPET_CHARS).alias("snippet"),
        )

    if whole:
        # a blank before the page makes the first part what stands before the first headline
        parts = F.split(F.concat(F.lit(" "), F.col(body)), f"(?={_NEWS_H3})")
        windows = F.slice(parts, F.lit(2), F.size(parts))
    else:
        windows = F.regexp_extract_all(
            F.col(body),
            F.lit(rf"(?={_NEWS_H3})(?=((?s:.{{1,{v.RESULT_WINDOW_CHARS}}})))"),
            F.lit(1),
        )
    return _explode(df, F.transform(_accepted(windows, fields, max_results), article), body, None)


def parse_wechat_html(df: DataFrame, body: str = "body", max_results: int | None = None) -> DataFrame:
    """Account-article result page. A block's own time mark dates it; a block without one takes the
    mark at its position among the accepted blocks."""
    link = r'<(?i:a[^>]*href="(/link\?url=[^"]*)"[^>]*>)' + _until("a")

    def clean(c: Column) -> Column:
        return t.decode_entities(t.trim_ws(t.strip_tags(c)), v.WECHAT_ENTITIES)

    def fields(b: Column) -> Column:
        return F.struct(
            b.alias("block"),
            clean(F.regexp_extract(b, link, 2)).alias("title"),
            F.regexp_extract(b, r"timeConvert\('([0-9]+)'\)", 1).alias("mark"),
        )

    def account(b: Column) -> Column:
        spans = F.transform(
            F.regexp_extract_all(b, F.lit("<(?i:span)[^>]*>([^<]{2,})</(?i:span>)"), F.lit(1)), t.trim_ws
        )
        named = F.filter(
            spans, lambda s: ~t.contains_any(s, ["document.write", "timeConvert"]) & F.length(s).between(2, 49)
        )
        return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(v.WECHAT_OUTLET))

    def articles(page: Column) -> Column:
        def article(r: Column, i: Column) -> Column:
            seconds = F.coalesce(t.blank_to_null(r["mark"]), F.try_element_at(page["marks"], i + 1)).try_cast("bigint")
            summary = clean(F.regexp_extract(r["block"], r'<(?i:p[^>]*class="[^"]*s-p[^"]*"[^>]*>)' + _until("p"), 1))
            return F.struct(
                r["title"].alias("title"),
                F.concat(F.lit(v.WECHAT_LINK_ROOT), F.regexp_extract(r["block"], link, 1)).alias("url"),
                t.bind(seconds, lambda x: dates.epoch_day(x, 2_000_000_000)).alias("date"),
                account(r["block"]).alias("media"),
                t.truncate(summary, v.SNIPPET_CHARS).alias("snippet"),
            )

        return F.transform(page["blocks"], article)

    parts = F.split(F.col(body), 'class="txt-box"')
    page = F.struct(
        F.regexp_extract_all(F.col(body), F.lit(r"timeConvert\('([0-9]+)'\)"), F.lit(1)).alias("marks"),
        _accepted(F.slice(parts, F.lit(2), F.size(parts)), fields, max_results).alias("blocks"),
    )
    return _explode(df, t.bind(page, articles), body, None)


_WECHAT_API = (
    "data struct<results:struct<data:array<struct<items:array<struct<"
    "title:string,doc_url:string,timestamp:string,source:struct<title:string>,desc:string>>>>>>"
)
_NEWS_API = (
    "value array<struct<name:string,url:string,datePublished:string,description:string,"
    "provider:array<struct<name:string>>,image:struct<thumbnail:struct<contentUrl:string>>>>"
)


def parse_wechat_api(df: DataFrame, body: str = "body", max_results: int | None = None) -> DataFrame:
    """JSON of the account-article API; rows without title or link are dropped."""

    def article(i: Column) -> Column:
        return F.struct(
            t.clean_api_text(i["title"]).alias("title"),
            i["doc_url"].alias("url"),
            F.coalesce(t.bind(i["timestamp"].try_cast("bigint"), lambda x: dates.epoch_day(x)), F.lit("")).alias("date"),
            F.coalesce(t.blank_to_null(i["source"]["title"]), F.lit(v.WECHAT_OUTLET)).alias("media"),
            t.truncate(t.clean_api_text(F.coalesce(i["desc"], F.lit(""))), v.SNIPPET_CHARS).alias("snippet"),
        )

    lists = F.from_json(F.col(body), _WECHAT_API)["data"]["results"]["data"]
    items = F.try_element_at(lists, F.lit(1))["items"]
    items = F.filter(items, lambda i: (i["title"] != "") & (i["doc_url"] != ""))
    return _explode(df, F.transform(items, article), body, max_results)


def parse_news_api(df: DataFrame, body: str = "body", max_results: int | None = None) -> DataFrame:
    """JSON of the news API; also keeps the thumbnail link as ``image_url``."""

    def article(i: Column) -> Column:
        provider = F.try_element_at(i["provider"], F.lit(1))["name"]
        return F.struct(
            F.coalesce(t.blank_to_null(i["name"]), F.lit(v.NO_TITLE)).alias("title"),
            F.coalesce(i["url"], F.lit("")).alias("url"),
            dates.api_date_day(i["datePublished"]).alias("date"),
            F.coalesce(
                t.blank_to_null(provider), t.blank_to_null(urls.site(i["url"])), F.lit(v.UNKNOWN_OUTLET)
            ).alias("media"),
            F.coalesce(i["description"], F.lit("")).alias("snippet"),
            i["image"]["thumbnail"]["contentUrl"].alias("image_url"),
        )

    return _explode(df, F.transform(F.from_json(F.col(body), _NEWS_API)["value"], article), body, max_results)


# --- guards, union, choice of engines --------------------------------------------------------------

def block_reason(body: Column, min_chars: int, pattern: str | None = None, head: int | None = None) -> Column:
    """Why a payload must not be parsed: ``too_short``, ``challenge`` or NULL for a usable one."""
    reason = F.when(F.length(F.coalesce(body, F.lit(""))) < min_chars, "too_short")
    if pattern:
        text = body if head is None else F.substring(body, 1, head)
        reason = reason.when(text.rlike(pattern), "challenge")
    return reason


def rss_block_reason(body: Column) -> Column:
    return block_reason(body, 200)


def wechat_block_reason(body: Column) -> Column:
    return block_reason(body, 1000, "请输入验证码|antispider")


def page_block_reason(body: Column) -> Column:
    return block_reason(body, 1000, v.BLOCK_PAGE_PATTERN, 3000)


#: What makes a payload of an engine unusable; engines without an entry have no such sign.
ENGINE_GUARDS = {"rss": rss_block_reason, "wechat_html": wechat_block_reason}
ENGINES = ("news_html", "rss", "news_api", "wechat_api", "wechat_html")


def payload_reason(engine: Column, body: Column) -> Column:
    """Why a landed payload is not parsed: ``unknown_engine``, the reason of its engine's guard, or NULL."""
    reason = F.when(~F.coalesce(engine.isin(*ENGINES), F.lit(False)), "unknown_engine")
    for name, guard in ENGINE_GUARDS.items():
        reason = reason.when(engine == name, guard(body))
    return reason


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """Landed payloads that no parser reads, with their ``block_reason``."""
    return quarantine(payloads, payload_reason(F.col("engine"), F.col("body")))[1]


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Usable payloads, and the rejected ones with their ``block_reason``."""
    tagged = df.withColumn("block_reason", reason)
    return tagged.where("block_reason IS NULL").drop("block_reason"), tagged.where("block_reason IS NOT NULL")


def union_engines(**tables: DataFrame) -> DataFrame:
    """Union of article tables with the keyword name as ``source``."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def choose_engines(df: DataFrame, mode: str = "all", column: str = "source") -> DataFrame:
    """Rows of one engine family, or all. On a table partitioned by ``source`` this prunes folders."""
    return df.where(F.col(column) == mode) if mode in ("news", "wechat") else df
