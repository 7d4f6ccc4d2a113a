import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.functions import dates, similarity, text as t, urls
from newsgauge.operators import funnel, keywords as kw
from newsgauge.sources.payloads import short_outlet


def test_split_title_outlet(apply):
    titles = ["标题 - 媒体", "标题_ 媒体", "标题", " - x", "a - b - c", "标题_ 不 行", "a_ b_ 新网"]
    got = apply(lambda c: t.split_title_outlet(c), titles)
    assert [tuple(r) for r in got] == [
        ("标题", "媒体"), ("标题", "媒体"), ("标题", v.UNKNOWN_OUTLET), (" - x", v.UNKNOWN_OUTLET), ("a - b", "c"),
        ("标题_ 不 行", v.UNKNOWN_OUTLET), ("a_ b", "新网"),
    ]
    tagged = apply(lambda c: t.split_title_outlet(c, t.F.lit(" 来自标签 ")), ["标题"])
    assert tuple(tagged[0]) == ("标题", "来自标签")


def test_entities_decode_in_order(apply):
    assert apply(lambda c: t.decode_entities(c), ["&amp;lt;b&gt;&#39;&nbsp;"]) == ["<b>' "]
    # the account list decodes & after the quotes, so an escaped quote stays escaped
    assert apply(lambda c: t.decode_entities(c, v.WECHAT_ENTITIES), ["&amp;ldquo;&ldquo;"]) == ["&ldquo;“"]


def test_whitespace(apply):
    assert apply(t.trim_ws, ["　 a b \n", "", "﻿"]) == ["a b", "", ""]
    assert apply(t.html_to_text, ["<p>a</p>\n<b>b</b>"]) == ["a b"]


def test_unescape_unicode(apply):
    got = apply(t.unescape_unicode, ["a\\u4e2dz", "\\ud83d\\ude00", "\\ud83dx", "plain", "\\u12"])
    assert got == ["a中z", "😀", "�x", "plain", "\\u12"]


@pytest.mark.parametrize("name, unreliable", [
    ("news.cnr.cn", True), ("CARNOC.com", True), ("标题_凤凰网", True), ("文化", True), ("百家号X", True),
    ("光明日报", False), ("", True), (" 未知来源 ", True), ("新华网5月", True), ("“新”报道", True), ("中国.cn网", False),
])
def test_unreliable_outlet(apply, name, unreliable):
    assert apply(t.is_unreliable_outlet, [name]) == [unreliable]


def test_plausible_outlet(apply):
    names = ["官方账号：新华网站", "北京日报", "abc", "新闻（一）", "第3频道", "相关推荐栏", "搜狐新闻", "长" * 41, "来自媒体：光明"]
    assert apply(t.is_plausible_outlet, names) == [True, True, False, False, False, False, False, False, False]
    assert apply(lambda c: t.is_plausible_outlet(c, True), ["搜狐新闻"]) == [True]


PAGES = [
    ('<meta name="mediaid" content="新华日报">', "新华日报"),
    ('<META NAME="MEDIAID" CONTENT="新华日报">', "新华日报"),
    ('<div class="x author-name y"> 北京晚报 </div>', "北京晚报"),
    ('<div data-testid="author-name">第3</div><p class="author-name">北京晚报</p>', None),
    ('var nickname = htmlDecode("建筑时报");', "建筑时报"),
    ('"nickname": "工人之家"', "工人之家"),
    ("来源：<b>审核</b> x 来源：<span>呼和浩</span><span>特晚报</span> 责任编辑 张", "呼和浩特晚报"),
    ("来源：\\u65b0\\u534e\\u7f51 2020", "新华网"),
    ("来源：甲、北京日报，丙新闻网；记者", "丙新闻网"),
    ('<meta property="og:site_name" content="光明在线">', "光明在线"),
    ('<meta name="source" content="经济之声">', "经济之声"),
    ("<title>标题 - 中国之声</title>", "中国之声"),
    ("<title>标题_新闻网 - </title>", "新闻网 -"),
    ("<title>a—晚报社</title>", "晚报社"),
    ("no marks", None),
    ("来源：" + "x" * 700 + "来源：人民之声", "人民之声"),
]


def test_outlet_from_page(apply):
    assert apply(t.outlet_from_page, [p for p, _ in PAGES]) == [n for _, n in PAGES]


def test_organisation_variants(apply):
    names = ["中建集团有限公司", "集团", " 甲乙丙丁有限责任公司", ""]
    assert apply(t.organisation_variants, names) == [["中建集团有限公司", "中建"], ["集团"], ["甲乙丙丁有限责任公司", "甲乙丙丁"], []]
    assert apply(lambda c: t.organisation_variants(c, quoted=True), ["公司名字有限公司"])[0][0] == '"公司名字有限公司"'


def test_matches_equals_rlike(spark):
    from pyspark.sql import functions as F

    patterns = [*v.EXCLUDE_PATTERNS, *(p for p, _ in v.NOISE_RULES), v.OWN_ACCOUNT_PATTERN, v.LOW_QUALITY_PATTERNS[1], v.SUBJECT_TAIL]
    texts = ["关于开展活动的通知", "关于x\n通知", "停水通知", "通知停水", "今天放假，公告如下", "投标", "a招聘b", "2024-01-01", "2024-01-01\n",
             "甲项目工程", "关于", "", "中国建筑报", "日报", "A股大涨"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for p in patterns:
        fast = t.matches(F.col("x"), p)
        plain = F.col("x").rlike(t.anchored(p))
        assert df.where(fast != plain).count() == 0, p


def test_canonical_url(apply):
    got = apply(urls.canonical_url, [
        "http://www.a.com/x?utm_source=1", "https://a.com/x", "A.com", "http://A.com:80", "http://a b.com/x ",
        "https://x.gov.cn/a?b=1&from=2&c#f", "https://a.com/?from=1&source=2&a=1&&b", "", "http://a.com/p?xfrom=1&from2=2",
    ])
    assert got == ["a.com/x", "a.com/x", "a.com/", "a.com/", "a b.com/x", "x.gov.cn/a?b=1&c=", "a.com/?a=1&b=", "", "a.com/p?xfrom=1&from2=2"]
    assert apply(lambda c: urls.dedup_url(c), ["https://a.com/" + "x" * 300])[0] == "a.com/" + "x" * 300
    assert apply(lambda c: urls.dedup_url(c, 150), ["https://a.com/" + "x" * 300])[0] == ("a.com/" + "x" * 300)[:150]


def test_host_names(apply):
    got = apply(short_outlet, ["https://www.m.thepaper.cn/x", "https://finance.sina.com.cn/", "http://www.other.org/a", "no url"])
    assert got == ["澎湃新闻", "新浪", "other.org", "no url"]


def test_normalise_date(apply):
    said = ["今天", "昨天", "前天", "5天前", "3小时前", "10分钟前", "8月12日", "2026-8-1", "other", "", "发布于 2 天前"]
    got = apply(lambda c: dates.normalise_date(c, dt.datetime(2026, 8, 15, 2, 5)), said)
    assert got == ["2026-08-15", "2026-08-14", "2026-08-13", "2026-08-10", "2026-08-14", "2026-08-15", "2026-08-12", "2026-08-01",
                   "other", "", "2026-08-13"]


def test_dates_do_not_depend_on_the_session_zone(spark, apply):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
        assert apply(dates.epoch_day, [1689848555], "bigint") == ["2023-07-20"]
        assert apply(dates.mail_date_day, ["Thu, 13 Aug 2026 23:00:00 GMT"]) == ["2026-08-13"]
        assert apply(lambda c: dates.normalise_date(c, "2026-08-15T23:30:00"), ["今天"]) == ["2026-08-15"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_epoch_day(apply):
    s = [0, 999999999, 1689848555, 2000000001]
    assert apply(lambda c: dates.epoch_day(c, 2_000_000_000), s, "bigint") == ["", "", "2023-07-20", ""]
    assert apply(dates.epoch_day, s, "bigint")[3] == "2033-05-18"


def test_mail_dates(apply):
    said = ["Thu, 13 Aug 2026 07:00:00 GMT", "Thu, 13 Aug 2026 07:00:00 +0800", "13 Aug 2026", "2026-08-12T23:30:00-05:00", "junk", ""]
    assert apply(dates.mail_date_day, said) == ["2026-08-13", "2026-08-12", "2026-08-13", "2026-08-13", "junk", ""]
    assert apply(dates.api_date_day, [said[3]]) == ["2026-08-12"]


def test_check_range():
    assert dates.check_range("2024-01-01", "2024-01-01") == ("2024-01-01", "2024-01-01")
    for bad in (("", "2024-01-01"), ("2024-01-02", "2024-01-01"), ("x", "2024-01-01")):
        with pytest.raises(ValueError):
            dates.check_range(*bad)


def test_range_reason_agrees_with_the_argument_check(apply):
    asked = [("2024-01-01", "2024-01-01"), ("", "2024-01-01"), ("2024-01-01", None), (None, None), ("2024-01-02", "2024-01-01"), ("x", "2024-01-01"),
             ("2024-02-30", "2024-03-01"), ("2024-01-01", "2024-1-5"), ("2023-12-31", "2024-01-01\n")]
    got = apply(dates.range_reason, asked, ["string", "string"])
    assert got == [None, "missing", "missing", "missing", "starts_after_end", "not_a_date", "not_a_date", "not_a_date", "not_a_date"]
    for pair, reason in zip(asked, got):
        if reason is None:
            dates.check_range(*pair)
        else:
            with pytest.raises(ValueError):
                dates.check_range(*pair)


def test_title_similarity(apply):
    pairs = [("ABC", "abc"), ("abc", "cba"), ("abcd", "abxy"), ("", ""), ("", "x")]
    assert apply(similarity.title_similarity, pairs, ["string", "string"]) == [1.0, 1.0, 0.5, 1.0, 0.0]


def test_date_range_keeps_unparseable(apply):
    got = apply(lambda c: funnel.in_date_range(c, "2024-01-01", "2024-12-31"), ["", "5天前", "2024-06-01", "2023-06-01", "2024-06-01\n", None])
    assert got == [True, True, True, False, True, True]


def test_noise_first_rule_wins(apply):
    pairs = [("专利招聘", ""), ("关于召开会议的通知", ""), ("关于召开会议的通知", "正文"), ("标题", "免费领取"), ("标题", "正文")]
    assert apply(funnel.noise_reason, pairs, ["string", "string"]) == ["专利公告", "通知公告", None, "广告推广", None]


def test_literal_variants(apply):
    got = apply(kw.literal_variants, ["青海省国家区域医疗中心项目", "项目", "青海省博物馆", "甲工程"])
    assert got[0] == ["青海省国家区域医疗中心项目", "青海省国家区域医疗中心", "青海省国家区域医疗中心工程", "青海国家区域医疗中心"]
    assert got[1:] == [["项目"], ["青海省博物馆"], ["甲工程", "甲", "甲项目"]]


def test_co_occurrence(apply):
    got = apply(kw.co_occurrence, ["青海省国家区域医疗中心项目", "青海省医院项目", "国家中心", "内蒙古省高速公路收费站"])
    assert got == [["青海", "国家区域医疗中心"], None, None, ["内蒙古", "高速公路收费站"]]


def test_mentions_subject_apart_only_for_literals(apply, spark):
    from pyspark.sql import functions as F

    text = "国家区域医疗中心落地青海"
    terms, pair = F.array(F.lit("青海省国家区域医疗中心")), F.array(F.lit("青海"), F.lit("国家区域医疗中心"))
    assert apply(lambda c: funnel.mentions_subject(c, terms, pair), [text]) == [True]
    assert apply(lambda c: funnel.mentions_subject(c, terms), [text]) == [False]


def test_single_blanks_are_left_where_they_are(spark):
    """Only runs that change are replaced, with the same result as if every run were; counts are cast only where there is one."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [("".join(rng.choice("ab \t\n 　 é") for _ in range(rng.randrange(14))),) for _ in range(600)]
    df = spark.createDataFrame([*rows, (None,), ("a b c",), (" ",), ("  ",), ("\n",), ("a" + " " * 20_000 + "b" + "　 " * 9_000,)], "c string")
    wrong = df.where(~t.squeeze_ws(F.col("c")).eqNullSafe(F.regexp_replace("c", f"{t.WS}+", " ")))
    assert wrong.count() == 0
    assert {r[0] for r in df.where("c IN ('a b c', ' ')").select(F.size(F.regexp_extract_all("c", F.lit(t._WS_RUN), F.lit(0)))).collect()} == {0}
    said = ["", "soon", "天前", "3 天前", "99999999999999999999天前", "2024-1-5", "2小时前", "x分钟前", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, s string").select("i", dates.normalise_date(F.col("s"), "2024-03-05T02:30:00").alias("d"))
    assert [r["d"] for r in got.orderBy("i").collect()] == ["", "soon", "天前", "2024-03-02", "99999999999999999999天前", "2024-01-05", "2024-03-05", "x分钟前", ""]
    assert "nullif" in str(dates.normalise_date(F.col("s"), "2024-03-05T02:30:00")).lower()


def test_last_split_equals_the_pattern(apply):
    import re

    texts = ["", " - ", "a - b", " - a", "a -  - b", " -  - b", "a - - b", "a - ", "a_ b_ c", "\n - 中 - \n", "a-b", "😀 - 😀", None]
    for sep in (" - ", "_ ", "|"):
        want = [None if x is None else re.fullmatch(f"(?s)(.+){re.escape(sep)}(.*)", x) for x in texts]
        got = apply(lambda c: t.last_split(c, sep), texts)
        assert [tuple(r) for r in got] == [m.groups() if m else ("", "") for m in want]


def test_elements_end_at_the_next_end_tag(apply):
    """Whatever the case of tags and the signs between them, and without a stack that grows with them."""
    import random
    import re

    from newsgauge.sources.payloads import _until

    rng = random.Random(1)
    texts = ["".join(rng.choice(("<", "</", "a", ">", "</a>", "</A>", "<a>", "<A>", "\n", "中")) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts.append("<a>" + "<b " * 100_000 + "</a>")
    want = [m[1] if (m := re.search("(?is)<a>(.*?)</a>", x)) else "" for x in texts]
    assert apply(lambda c: F.regexp_extract(c, f"<(?i:a>){_until('a')}", 1), texts) == want
    assert sum(map(bool, want)) > 10


def test_entities_and_cdata_equal_plain_replacements(apply):
    texts = ["&amp;lt; &amp;amp;amp; &&lt;", "a", "<![CDATA[x]]>", "]<![CDATA[]>", "<![CDATA[<![CDATA[]]>]]", "]]]>>", None]
    for entities in (v.RSS_TITLE_ENTITIES, v.WECHAT_ENTITIES, (("x", "<"), ("<", "y"))):
        def decoded(x):
            for a, b in entities:
                x = x and x.replace(a, b)
            return x
        assert apply(lambda c: t.decode_entities(c, entities), texts) == [decoded(x) for x in texts]
    assert apply(t.strip_cdata, texts) == ["&amp;lt; &amp;amp;amp; &&lt;", "a", "x", "]]>", "]]", "]>", None]


def test_spaces_are_the_same_class_for_java(spark):
    every = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.where(F.col("c").rlike(t._WS_SOON) != F.col("c").rlike(t.WS)).isEmpty()
