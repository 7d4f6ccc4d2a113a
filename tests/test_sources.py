import json

from pyspark.sql import functions as F

from newsgauge.functions import text as t
from newsgauge.sources import payloads as p

RSS = """<rss><item><title><![CDATA[某项目封顶 &amp; 完工 - 新华社]]></title><link> https://a.com/1 </link>
<pubDate>Thu, 13 Aug 2026 23:00:00 -0200</pubDate><description><![CDATA[<a href="x">摘要</a> &lt;一&gt;]]></description></item>
<item><title>短</title></item><ITEM><title>标题在此</title><source url="u">来源报</source></ITEM>
<item><title>第三条标题_ 人民网</title></item></rss>"""


def rows(df):
    return [r.asDict() for r in df.orderBy("pos").collect()]


def body(spark, text):
    return spark.createDataFrame([(text,)], "body string")


def test_rss(spark):
    got = rows(p.parse_rss(body(spark, RSS)))
    assert [r["title"] for r in got] == ["某项目封顶 & 完工", "标题在此", "第三条标题"]
    assert got[0] == {"pos": 0, "title": "某项目封顶 & 完工", "url": "https://a.com/1", "date": "2026-08-14", "media": "新华社", "snippet": "摘要 <一>"}
    assert [r["media"] for r in got] == ["新华社", "来源报", "人民网"]
    assert len(rows(p.parse_rss(body(spark, RSS), max_results=2))) == 2


def test_news_html(spark):
    def item(title, tail):
        return f'<div><h3 class="news-title_1YtI1"> <a href="https://x.com/{title}" target="_blank"><em>{title}</em></a></h3>{tail}</div>'

    html = (
        item("第一条新闻标题", '<p>摘要 8月1日</p><div class="news-source_X"><span aria-label="新闻来源：光明网">光明网</span> 5天前</div>')
        + item("第二条（新闻", '<div class="news-source_X"><a class="source-link_F" href="https://baijiahao.baidu.com/s">b</a><span>8月12日</span></div>')
        + item("短题", "") + "x" * 2000
        + item("最后一条标题", '<p>3小时前</p><span aria-label="发布于：2026-8-1">d</span>')
    )
    got = rows(p.parse_news_html(body(spark, html), "2026-08-15T02:00:00"))
    assert [(r["title"], r["media"], r["date"]) for r in got] == [
        ("第一条新闻标题", "光明网", "2026-08-10"), ("第二条（新闻", "百度百家号", "2026-08-12"), ("最后一条标题", "未知来源", "2026-08-01"),
    ]
    assert got[0]["url"] == "https://x.com/第一条新闻标题"
    # a window runs over the following results, as the page text does
    assert got[0]["snippet"].startswith("摘要 8月1日 光明网 5天前 第二条（新闻")
    assert all(len(r["snippet"]) <= 200 for r in got)


def test_news_html_whole_results(spark):
    """A result may be longer than any window, and nothing of the next one is taken for its own."""
    head = '<H3 class="a news-title_1"> <a href="https://x.com/%d">%s</a></h3>'
    html = (head % (1, "第一条新闻标题") + "<p>" + "长" * 4000 + '</p><div class="news-source_X"><span aria-label="新闻来源：光明网"></span>3天前</div>'
            + head % (2, "第二条新闻标题") + "<p>摘要</p>" + head % (3, "第三条新闻标题")
            + '<div class="news-source_X"><a class="source-link_F" href="https://baijiahao.baidu.com/s">b</a><i>8月2日</i></div>')
    got = rows(p.parse_news_html(body(spark, html), "2026-08-15T02:00:00", whole=True))
    assert [(r["title"], r["media"], r["date"]) for r in got] == [
        ("第一条新闻标题", "光明网", "2026-08-12"), ("第二条新闻标题", "未知来源", ""), ("第三条新闻标题", "百度百家号", "2026-08-02")]
    assert [r["snippet"] for r in got] == ["长" * 200, "摘要", "b 8月2日"]
    cut = rows(p.parse_news_html(body(spark, html), "2026-08-15T02:00:00"))
    assert cut[0]["media"] == "未知来源" and cut[1]["media"] == "百度百家号"
    for nothing in ("", "<html></html>", "<h3 class='x'>y</h3>", None):
        assert rows(p.parse_news_html(body(spark, nothing), "2026-08-15T02:00:00", whole=True)) == []
    assert [r["pos"] for r in rows(p.parse_news_html(body(spark, html), "2026-08-15T02:00:00", max_results=2, whole=True))] == [0, 1]


def test_space_class(spark):
    """The class finds the characters that its list of spaces names, and no others."""
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(f"^{t._WS_SOON}\\z") & F.col("c").rlike(t.WS)).collect()
    assert {r["c"] for r in found} == {c for c in chars if c in t._SPACES}


def test_wechat_html(spark):
    def block(i, title, mark=True, account="某公众号"):
        time = f"<script>document.write(timeConvert('{1689848555 + 86400 * i}'))</script>" if mark else ""
        return f'<div class="txt-box"><h3><a href="/link?url={i}">{title}</a></h3><p><span>x</span><span>{account}</span></p><p class="s-p">摘要&hellip;</p>{time}</div>'

    html = block(0, "第一篇文章") + block(1, "短") + block(2, "第二<em>篇</em>文章", account="document.write()") + block(3, "没有时间的", mark=False)
    got = rows(p.parse_wechat_html(body(spark, html)))
    assert [(r["title"], r["media"], r["date"]) for r in got] == [
        ("第一篇文章", "某公众号", "2023-07-20"), ("第二篇文章", "微信公众号", "2023-07-22"), ("没有时间的", "某公众号", "2023-07-22"),
    ]
    assert got[0]["url"] == "https://weixin.sogou.com/link?url=0" and got[0]["snippet"] == "摘要…"
    assert rows(p.parse_wechat_html(body(spark, "nothing"))) == []


def test_wechat_api(spark):
    items = [
        {"title": "<em class='h'>标题</em>&amp;", "doc_url": "https://a", "timestamp": 1689848555, "source": {"title": "号"}, "desc": "<b>x</b>"},
        {"title": "无链接", "doc_url": ""}, {"title": "t", "doc_url": "u", "timestamp": "12"},
    ]
    got = rows(p.parse_wechat_api(body(spark, json.dumps({"data": {"results": {"data": [{"items": items}]}}}))))
    assert [(r["title"], r["date"], r["media"], r["snippet"]) for r in got] == [("标题&", "2023-07-20", "号", "x"), ("t", "", "微信公众号", "")]
    assert rows(p.parse_wechat_api(body(spark, '{"data":{"results":{"data":[]}}}'))) == []
    assert rows(p.parse_wechat_api(body(spark, "not json"))) == []


def test_news_api(spark):
    value = [{"name": "标题", "url": "https://www.a.com/x", "datePublished": "2026-08-12T10:30:00.0000000Z", "description": "d"},
             {"url": "bad", "provider": [{"name": "某报"}]}, {"name": "x", "url": ""}]
    got = rows(p.parse_news_api(body(spark, json.dumps({"value": value}))))
    assert [(r["title"], r["date"], r["media"]) for r in got] == [("标题", "2026-08-12", "a.com"), ("无标题", None, "某报"), ("x", None, "未知来源")]


def test_guards(spark):
    df = spark.createDataFrame([("a" * 300,), ("short",), (None,), ("请输入验证码" + "x" * 2000,), ("x" * 4000 + "安全验证",)], "body string")
    body_ = df["body"]
    got = df.select(p.rss_block_reason(body_), p.wechat_block_reason(body_), p.page_block_reason(body_)).collect()
    assert [r[0] for r in got] == [None, "too_short", "too_short", None, None]
    assert [r[1] for r in got] == ["too_short", "too_short", "too_short", "challenge", None]
    assert [r[2] for r in got] == ["too_short", "too_short", "too_short", "challenge", None]
    usable, rejected = p.quarantine(df, p.page_block_reason(body_))
    assert usable.count() == 1 and rejected.count() == 4


def test_pages_fetched_twice_lose_nothing(spark):
    """Two fetches of one page with other items, and one body landed twice."""
    from newsgauge.plans.search import request_articles

    def feed(*numbers):
        words = ("开工仪式", "封顶大吉", "竣工验收", "道路通车", "桥梁合龙", "隧道贯通", "电站并网")
        items = "".join(
            f"<item><title>{words[n % 7]}现场报道第{n}号独家稿件 - 报社{n}</title><link>https://a.example/{n}</link>"
            "<pubDate>Mon, 04 Mar 2024 08:00:00 GMT</pubDate></item>" for n in numbers)
        return f"<rss>{items}</rss>" + " " * 300

    rows = [("rss", "甲", 0, 0, 1, feed(1, 2, 3), "2024-03-05 00:00:00"), ("rss", "甲", 0, 0, 1, feed(4, 5, 6), "2024-03-05 06:00:00"),
            ("rss", "甲", 0, 0, 1, feed(4, 5, 6), "2024-03-05 07:00:00"), ("rss", "甲", 0, 0, 2, "blocked", "2024-03-05 07:00:00")]
    landed = spark.createDataFrame(rows, "engine string, keyword string, keyword_rank int, query_rank int, page_no int, body string, fetched_at string")
    got = [r["url"] for r in request_articles(landed, "2024-03-05T02:00:00").orderBy("ord").collect()]
    assert got == [f"https://a.example/{n}" for n in range(1, 7)]


def test_streams_and_batches_share_their_guards(spark):
    from newsgauge.sources.payloads import rejected_payloads
    from newsgauge.streaming.landing import parse_landing

    rows = [("rss", "k", "<item><title>这是一个足够长的标题</title></item>"), ("other", "k", "x" * 500), (None, "k", "x"), ("news_api", "k", "{}")]
    landed = spark.createDataFrame(rows, "engine string, keyword string, body string")
    assert parse_landing(landed, "rss", "2024-03-05T02:00:00").count() == 0
    got = sorted((r["engine"] or "", r["block_reason"]) for r in rejected_payloads(landed).collect())
    assert got == [("", "unknown_engine"), ("other", "unknown_engine"), ("rss", "too_short")]


def test_account_queries_can_share_the_places(spark):
    import json

    from newsgauge.plans import search

    def page(query):
        return json.dumps({"query": query})

    rows = [("wechat_api", "甲", 0, q, 1, page(q)) for q in (0, 1)]
    landed = spark.createDataFrame(rows, "engine string, keyword string, keyword_rank int, query_rank int, page_no int, body string")
    parsed = landed.selectExpr("*", "body AS payload", "0 AS engine_rank", "explode(sequence(1, 9)) AS pos").drop("body").selectExpr(
        "*", "concat('https://a/', query_rank, '/', pos) AS url", "concat('标题', query_rank, pos) AS title")
    original, search._parse = search._parse, lambda *a: parsed
    try:
        got = {share: sorted(r["url"] for r in search.wechat_articles(landed, "2024-03-05T02:00:00", 6, share).collect()) for share in (False, True)}
    finally:
        search._parse = original
    assert got[False] == [f"https://a/0/{n}" for n in range(1, 7)]
    assert got[True] == [f"https://a/{q}/{n}" for q in (0, 1) for n in (1, 2, 3)]


def test_page_numbers_do_not_wrap(spark):
    from pyspark.sql import functions as F

    from newsgauge.catalogue.parsing import page_of
    from newsgauge.plans.search import news_articles

    ids = [0, 59, 60, 983_039, 983_040, 60 << 33]
    got = [r["p"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", page_of(F.col("i")).alias("p")).orderBy("i").collect()]
    assert got == [0, 0, 1, 16_383, 16_384, 1 << 33]
    rows = [("rss", "k", 0, 0, page, f"<rss><item><title><![CDATA[{title}]]></title><link>https://a.com/{page}</link></item>{' ' * 2000}</rss>")
            for page, title in ((1 << 33, "桥梁建设完成通车"), (3, "新的学校今天开学"))]
    landed = spark.createDataFrame(rows, "engine string, keyword string, keyword_rank int, query_rank int, page_no long, body string")
    assert [r["title"] for r in news_articles(landed, "2026-08-14T00:00:00", max_per_query=1).collect()] == ["新的学校今天开学"]


def test_whole_lists_of_all_engines(spark):
    """News rows of whole lists against the sequential rule, besides the check SQL."""
    from pyspark.sql import functions as F
    from test_operators import merged_by_hand

    from newsgauge.catalogue.parsing import _landed, landed_search_whole
    from newsgauge.catalogue.views import AS_OF
    from newsgauge.functions.urls import canonical_url
    from newsgauge.plans import search

    sf = "/root/testdata/sf0.001"
    landed = _landed(spark, sf).where("keyword_rank % 4 = 1")
    rows = search._parse(landed, search.NEWS_ENGINES, AS_OF).withColumn("key", canonical_url(F.col("url"), trim=False)).collect()
    rows = sorted(({**r.asDict(), "url": r["key"], "link": r["url"]} for r in rows), key=lambda r: (r["keyword"], r["query_rank"], r["engine_rank"], r["page_no"], r["payload"], r["pos"]))
    want = {}
    for keyword in {r["keyword"] for r in rows}:
        per_query = [x for q in range(3) for x in merged_by_hand([r for r in rows if r["keyword"] == keyword and r["query_rank"] == q])]
        want[keyword] = [r["link"] for r in merged_by_hand(per_query)]
    got = {}
    for r in landed_search_whole(spark, sf).where("source = 'news'").orderBy("ord").collect():
        got.setdefault(r["keyword"], []).append(r["url"])
    assert len(want) > 2 and max(map(len, want.values())) > 30
    assert {k: got[k] for k in want} == want
