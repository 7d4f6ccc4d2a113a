import pytest

from newsgauge.plans.coverage import Dimensions, Settings, coverage_report
from newsgauge.plans.search import request_articles

A = "ord long, keyword string, title string, url string, date string, media string, snippet string, source string"
ROWS = [
    (0, "甲", "甲中心项目全面封顶", "https://www.a.com/1?spm=1", "2024-03-01", "新华社", "", "news"),
    (1, "甲", "甲中心项目全面封顶", "http://a.com/1", "2024-03-01", "北京日报", "", "news"),        # same link
    (2, "甲", "甲中心项目顺利通过验收", "https://news.google.com/x", "5天前", "搜狐", "", "news"),   # link resolved, page names outlet
    (3, "甲", "甲中心招聘公告", "https://a.com/3", "2024-03-01", "x", "", "news"),                   # noise
    (4, "甲", "别的事情", "https://a.com/4", "2024-03-01", "x", "", "news"),                          # not about it
    (5, "甲", "甲中心", "https://a.com/5", "2020-01-01", "x", "", "news"),                            # out of range, silent
    (6, "甲", "甲中心动态消息", "https://a.com/6", "", "某某八局", "", "wechat"),                     # own account
    (7, "甲", "甲中心动态消息", "https://a.com/7", "", "某人说", "", "wechat"),                       # personal account
    (8, "乙", "乙馆与甲中心同日开工", "https://www.a.com/1?spm=1", "2024-03-02", "央广网", "", "news"),         # link owned by the first keyword
    (9, "乙", "乙馆月报", "https://a.com/9", "2024-03-02", "央广网", "", "news"),                     # scores below zero
    (10, "乙", "乙馆正式启用", "https://a.com/10?x=1&amp;y=2", "2024-03-02", "news.cnr.cn", "", "news"),
    (11, "乙", "乙馆正式启用了", "https://a.com/11", "2024-03-02", "搜狐", "", "news"),               # page shows an own account
]


@pytest.fixture(scope="module")
def run(spark):
    def go(parts=3):
        articles = spark.createDataFrame(ROWS, A).repartition(parts)
        keywords = spark.createDataFrame([("乙", 1), (" 甲 ", 0), ("丙", 2)], "keyword string, keyword_rank int")
        subjects = spark.createDataFrame([(0, "甲中心", ["甲"], ["甲中心"])], "ord int, primary string, aliases array<string>, terms array<string>")
        outlets = spark.createDataFrame([(0, "新华", "中央级"), (1, "央广", "央广")], "ord int, key string, value string")
        labels = spark.createDataFrame([("某人说", "个人账号")], "media string, category string")
        resolved = spark.createDataFrame([("https://news.google.com/x", "https://real.com/x")], "url string, final_url string")
        pad = " " * 1000
        pages = spark.createDataFrame([
            ("https://real.com/x", "", '<meta name="mediaid" content="新华日报">' + pad),
            ("https://a.com/11", "", '<meta name="mediaid" content="中建新闻">' + pad),
        ], "url string, final_url string, html string")
        return coverage_report(articles, keywords, Dimensions(subjects, outlets, labels, resolved, pages), Settings("2024-01-01", "2024-12-31"))

    return go


@pytest.fixture(scope="module")
def report(run):
    return run()


def test_every_row_has_its_outcome(report):
    got = {r["ord"]: (r["status"], r["filter_reason"]) for r in report.rows.collect()}
    assert got == {
        0: ("kept", None), 1: ("filtered", "重复内容"), 2: ("kept", None), 3: ("filtered", "招聘求职"), 4: ("filtered", "未提到具体项目名"),
        6: ("filtered", "自身发布内容"), 7: ("filtered", "个人账号"), 8: ("owned_elsewhere", None), 9: ("filtered", "报道评分不足"),
        10: ("kept", None), 11: ("filtered", "自身发布内容"),
    }


def test_names_and_links_are_corrected(report):
    got = {r["ord"]: (r["media"], r["url"], r["category"], r["project"]) for r in report.kept.collect()}
    assert got[2] == ("新华日报", "https://real.com/x", "中央级", "甲中心")
    assert got[10] == ("央广网", "https://a.com/10?x=1&y=2", "央广", "乙")


def test_counts(report):
    stats = {(r["dimension"], r["key"]): r["n"] for r in report.stats().collect()}
    assert stats[("total", "")] == 10
    assert (stats[("status", "kept")], stats[("status", "filtered")]) == (3, 7)
    assert [r["ord"] for r in report.rejected_sample(2).collect()] == [1, 3]
    assert {k[1]: n for k, n in stats.items() if k[0] == "category"} == {"中央级": 2, "央广": 1}
    assert {k[1]: n for k, n in stats.items() if k[0] == "project"} == {"甲中心": 2, "乙": 1}
    assert sum(n for k, n in stats.items() if k[0] == "filter_reason") == 7
    assert {r["keyword"]: (r["n_kept"], r["n_raw"]) for r in report.by_project().collect()} == {"甲": (2, 7), "乙": (1, 4), "丙": (0, 0)}
    assert tuple(report.verification().collect()[0]) == (2, 3, 0)
    funnel = {r["project"]: tuple(r)[1:] for r in report.funnel().collect()}
    assert funnel["甲中心"] == (7, 5, 4, 3, 3)
    ranked = [r["ord"] for r in report.ranked().orderBy("rank").collect()]
    # tier first, then score: the longer of the two central titles earns more
    assert ranked == [10, 2, 0]


def test_result_does_not_depend_on_partitions(run, report):
    key = lambda r: sorted(map(str, r.rows.select("ord", "status", "filter_reason", "media", "url", "category", "score").collect()))
    assert key(run(1)) == key(report) == key(run(7))


def test_texts_are_read_once(run, report, monkeypatch):
    """Nothing that is written or shuffled holds a title or snippet; exports take them from the articles."""
    from newsgauge.plans import coverage

    written = []
    cut = coverage.cut
    monkeypatch.setattr(coverage, "cut", lambda df: written.append(df) or cut(df))
    run()
    assert len(written) == 4 and not any({"title", "snippet"} & set(df.columns) for df in written)
    for df in written:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange" in line and ("title" in line or "snippet" in line)]
    texts = {r["ord"]: (r["title"], r["snippet"]) for r in report.with_texts(report.rows).collect()}
    assert texts == {r[0]: (r[2], r[6]) for r in ROWS if r[0] != 5}


def test_outlets_to_label(spark):
    """An outlet with a label that is no tier has been asked for; it does not come back."""
    rows = [(i, "甲", f"甲中心项目全面封顶{i}", f"https://a.com/{i}", "2024-03-01", media, "", "news") for i, media in enumerate(("怪名号", "没人知道号"))]
    subjects = spark.createDataFrame([(0, "甲中心", ["甲"], ["甲中心"])], "ord int, primary string, aliases array<string>, terms array<string>")
    labels = spark.createDataFrame([("怪名号", "没有的类")], "media string, category string")
    out = coverage_report(spark.createDataFrame(rows, A), spark.createDataFrame([("甲", 0)], "keyword string, keyword_rank int"),
                          Dimensions(subjects, labels=labels), Settings("2024-01-01", "2024-12-31"))
    assert {r["media"]: r["category"] for r in out.kept.collect()} == {"怪名号": "未分类", "没人知道号": "未分类"}
    assert [r["media"] for r in out.unlabelled().collect()] == ["没人知道号"]


def test_mode_and_range_are_checked(spark):
    with pytest.raises(ValueError):
        Settings("2024-02-01", "2024-01-01")


def test_request_articles_over_all_engines(spark):
    rss = "<rss>" + "".join(f"<item><title>甲中心新闻第{i}条消息{'一二三四五'[i] * 9} - 报社{i}</title><link>https://r.com/{i}</link></item>" for i in range(5)) + " " * 200 + "</rss>"
    html = '<h3 class="news-title_1"><a href="https://b.com/1">百度来的一条新闻</a></h3>'
    api = '{"data":{"results":{"data":[{"items":[{"title":"公众号文章","doc_url":"https://w/1"},{"title":"公众号文章","doc_url":"https://w/2"}]}]}}}'
    sogou = '<div class="txt-box"><a href="/link?url=1">公众号文章</a></div><div class="txt-box"><a href="/link?url=2">另一篇文章</a></div>' + " " * 1000
    rows = [("rss", rss), ("news_html", html), ("wechat_api", api), ("wechat_html", sogou), ("rss", "too short")]
    payloads = spark.createDataFrame([(e, "甲", 0, q, 0, b) for q, (e, b) in enumerate(rows)], "engine string, keyword string, keyword_rank int, query_rank int, page_no int, body string")
    got = request_articles(payloads, "2024-03-05T00:00:00").orderBy("ord").collect()
    assert [r["source"] for r in got] == ["news"] * 6 + ["wechat"] * 2
    assert [r["title"] for r in got[-2:]] == ["公众号文章", "另一篇文章"]
    assert {r["title"] for r in got[:6]} >= {"百度来的一条新闻"}
    assert len({r["ord"] for r in got}) == len(got)
    assert request_articles(payloads, "2024-03-05T00:00:00", "wechat").count() == 2


def test_stages_nulls_and_blanks(spark):
    """An own rule counts at its stage, NULL titles are judged, and blanks around keywords do not lose articles."""
    from newsgauge.plans.coverage import Dimensions, Settings, coverage_report, unrequested_articles

    subjects = spark.createDataFrame([(1, "项目", ["甲"], ["大桥"])], "ord int, primary string, aliases array<string>, terms array<string>")
    rows = [
        (1, " 甲 ", "大桥顺利合龙通车仪式举行", "https://a.example/1", "2024-01-02", "人民日报", None, "news"),
        (2, "甲", "大桥禁词内容", "https://a.example/2", "2024-01-02", "人民日报", "", "news"),
        (3, "甲", None, "https://a.example/3", "2024-01-02", None, None, "news"),
        (4, "乙", "大桥", "https://a.example/4", "2024-01-02", "人民日报", "", "news"),
    ]
    articles = spark.createDataFrame(rows, "ord long, keyword string, title string, url string, date string, media string, snippet string, source string")
    keywords = spark.createDataFrame([(" 甲", 0)], "keyword string, keyword_rank int")
    report = coverage_report(articles, keywords, Dimensions(subjects), Settings("2024-01-01", "2024-02-01", noise_rules=(("禁词", "自定规则"),)))
    got = {r["ord"]: (r["status"], r["filter_reason"], r["stage"]) for r in report.rows.collect()}
    assert got == {1: ("kept", None, None), 2: ("filtered", "自定规则", "content"), 3: ("filtered", "未提到具体项目名", "precision")}
    assert [tuple(r)[1:] for r in report.funnel().collect()] == [(3, 2, 1, 1, 1)]
    assert [r["ord"] for r in unrequested_articles(articles, keywords).collect()] == [4]


def test_request_end_to_end(spark):
    """Keywords find their articles in a landed table and are reported; one article may serve two keywords."""
    from newsgauge.plans.coverage import Dimensions, Settings
    from newsgauge.plans.request import request_report

    subjects = spark.createDataFrame([(1, "跨江大桥", ["甲"], ["跨江大桥"]), (2, "高速隧道", ["乙"], ["高速隧道"])], "ord int, primary string, aliases array<string>, terms array<string>")
    rows = [
        (7, "跨江大桥顺利合龙通车仪式", "https://a.example/1", "2024-01-02", "人民日报", "", "news"),
        (8, "高速隧道全线贯通仪式举行", "https://a.example/2", "2024-01-03", "新华社", "跨江大桥", "news"),
        (9, "无关内容的一篇长长报道", "https://a.example/3", "2024-01-03", "新华社", "", "news"),
    ]
    articles = spark.createDataFrame(rows, "ord long, title string, url string, date string, media string, snippet string, source string")
    keywords = spark.createDataFrame([("甲", 0), ("乙", 1)], "keyword string, keyword_rank int")
    report = request_report(articles, keywords, Dimensions(subjects), Settings("2024-01-01", "2024-02-01"))
    got = sorted((r["project"], r["landed_ord"], r["status"]) for r in report.rows.collect())
    assert got == [("跨江大桥", 7, "kept"), ("跨江大桥", 8, "kept"), ("高速隧道", 8, "owned_elsewhere")]


def test_request_reads_texts_apart_from_places(spark):
    """Places are found without the articles' texts; equal rows count once, and rows without an id are told apart."""
    from pyspark.sql import functions as F

    from newsgauge.plans.request import requested_articles
    from newsgauge.plans.search import search_places

    subjects = spark.createDataFrame([(1, "跨江大桥", ["甲"], ["跨江大桥"])], "ord int, primary string, aliases array<string>, terms array<string>")
    rows = [(7, "跨江大桥合龙", "u7", "2024-01-02", "a"), (7, "跨江大桥合龙", "u7", "2024-01-02", "a"), (8, "跨江大桥通车", "u8", "2024-01-03", "b"),
            (None, "跨江大桥检修", "u0", "2024-01-01", "c"), (None, "无关内容", "u1", "2024-01-04", "d"), (9, "无关内容", "u9", "2024-01-03", "e")]
    articles = spark.createDataFrame(rows, "ord long, title string, url string, date string, snippet string")
    keywords = spark.createDataFrame([("甲", 0)], "keyword string, keyword_rank int")
    found = requested_articles(articles, keywords, subjects).orderBy("ord").collect()
    assert [(r["landed_ord"], r["url"], r["keyword"]) for r in found] == [(8, "u8", "甲"), (7, "u7", "甲"), (None, "u0", "甲")]
    queries = spark.createDataFrame([("甲", 0, 0, "大桥")], "keyword string, keyword_rank int, query_rank int, term string")
    places = search_places(articles.where(F.col("ord") == 8), queries)
    assert set(places.columns) == {"ord", "date", "_row", "keyword", "keyword_rank", "query_rank", "term", "pos"} and places.count() == 1
