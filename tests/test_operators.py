import random

import pytest
from pyspark.sql import functions as F

from newsgauge import values as v
from newsgauge.operators import classify, dedup, joins, keywords as kw, lookup, report, score, verify
from newsgauge.operators.position import with_position
from newsgauge.plans.search import search_articles


def ids(df, col="ord"):
    return sorted(r[0] for r in df.select(col).collect())


# --- joins and lookups ------------------------------------------------------------------------------

def test_attach_with_a_hot_key(spark):
    left = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).otherwise(7).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    want = left.join(right, "k", "left")
    got = joins.attach(left, right, "k", "ord")
    assert sorted(map(tuple, got.select("ord", "k", "x").collect())) == sorted(map(tuple, want.select("ord", "k", "x").collect()))


@pytest.mark.parametrize("both_ways", [True, False])
def test_lookup_plans_agree(spark, both_ways):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("新华日报网台") for _ in range(rng.randint(1, n)))
    keys = list({word(4) for _ in range(40)})
    names = list({word(6) for _ in range(150)})
    dictionary = spark.createDataFrame([(i, k, f"t{i}") for i, k in enumerate(keys)], "ord int, key string, value string")
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def brute(n):
        if n in keys:
            return f"t{keys.index(n)}"
        return next((f"t{i}" for i, k in enumerate(keys) if k in n or (both_ways and n in k)), None)

    for inline in (1000, 0):
        got = {r["name"]: r["value"] for r in lookup.first_match(df, "name", dictionary, both_ways, inline).collect()}
        assert got == {n: brute(n) for n in names}, inline


def test_term_match_plans_agree(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    texts = [(i, text(rng.randint(0, 300))) for i in range(80)] + [(80, "a" * 5000), (81, "")]
    terms = [(f"k{i}", text(rng.choice([1, 2, 3, 5, 8, 9, 17]))) for i in range(60)]
    terms += [("again", terms[0][1]), ("tail", "a" * 17)]
    articles = spark.createDataFrame(texts, "ord long, text string")
    listed = spark.createDataFrame(terms, "keyword string, term string")
    want = sorted((i, k, t) for i, x in texts for k, t in terms if t in x)
    for inline in (1000, 0):
        got = lookup.match_terms(articles, F.col("text"), "ord", listed, inline)
        assert sorted(tuple(r) for r in got.select("ord", "keyword", "term").collect()) == want


def test_search_articles_newest_first(spark):
    rows = [(1, "甲项目封顶", "", "2024-01-01"), (2, "甲项目", "", "2024-03-01"), (3, "无关", "提到甲项目", "2024-02-01")]
    articles = spark.createDataFrame(rows, "ord long, title string, snippet string, date string")
    queries = spark.createDataFrame([("甲", 0, 0, "甲项目")], "keyword string, keyword_rank int, query_rank int, term string")
    got = search_articles(articles, queries, max_per_query=2)
    assert [r["ord"] for r in got.orderBy("pos").collect()] == [2, 3]


# --- keywords -----------------------------------------------------------------------------------------

SUBJECTS = [(0, "甲中心", ["甲", "共用名"], ["甲中心一期工程", "甲中心"]), (1, "乙大型体育馆", ["共用名"], []), (2, "丙", ["乙大型体育馆"], ["丙"])]


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame(SUBJECTS, "ord int, primary string, aliases array<string>, terms array<string>")


def test_resolve_and_plan(spark, subjects):
    asked = spark.createDataFrame([(k, i) for i, k in enumerate(["甲", "共用名", "乙大型体育馆", "青海省国家区域医疗中心项目", "甲中"])], "keyword string, keyword_rank int")
    got = {r["keyword"]: r for r in kw.plan_searches(kw.resolve_keywords(asked, subjects)).collect()}
    assert [(got[k]["project"], got[k]["score"]) for k in ("甲", "共用名", "乙大型体育馆", "甲中")] == [
        ("甲中心", 90), ("甲中心", 90), ("乙大型体育馆", 100), ("甲中", None)]
    assert got["甲"]["queries"] == ["甲中心一期工程", "甲中心", "甲", "共用名", "甲中心 封顶 竣工 验收", "中建八局 甲中心"]
    assert got["甲"]["match_terms"] == ["甲中心一期工程", "甲中心"] and got["甲"]["co_occur"] is None
    assert got["乙大型体育馆"]["match_terms"] == ["乙大型体育馆"]
    literal = got["青海省国家区域医疗中心项目"]
    assert literal["co_occur"] == ["青海", "国家区域医疗中心"] and len(literal["queries"]) == 4
    assert literal["wechat_queries"] == ["青海省国家区域医疗中心项目"]
    matches = kw.keyword_matches(asked, subjects).where("keyword = '乙大型体育馆'")
    assert sorted((r["primary"], r["score"]) for r in matches.collect()) == [("丙", 90), ("乙大型体育馆", 100)]


def test_query_rows(spark, subjects):
    asked = spark.createDataFrame([("甲", 3)], "keyword string, keyword_rank int")
    rows = kw.query_rows(kw.plan_searches(kw.resolve_keywords(asked, subjects))).orderBy("query_rank").collect()
    assert [tuple(r) for r in rows] == [("甲", 3, 0, "甲中心一期工程"), ("甲", 3, 1, "甲中心"), ("甲", 3, 2, "甲")]


# --- de-duplication --------------------------------------------------------------------------------------

def articles(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, url string, title string, snippet string")


def test_by_url_keeps_other_sites(spark):
    df = articles(spark, [("http://www.a.com/x?utm_source=1", "t", ""), ("https://a.com/x", "t", ""), ("https://b.com/x", "t", "")])
    once = dedup.by_url(df)
    assert ids(once) == [0, 2] and ids(dedup.by_url(once)) == [0, 2]


def test_flag_first_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}", rng.randint(0, 9)) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ord long, k string, rank int")
    first = {}
    for o, k, r in rows:
        first[k] = min(first.get(k, (99, 0)), (r, o))
    for n in (1, 7):
        got = dedup.flag_first(df.repartition(n), [F.col("k")], [F.col("rank"), F.col("ord")], "ord")
        assert got.count() == len(rows)
        assert ids(got.where("is_first")) == sorted(o for _, o in first.values())


def test_link_then_title(spark):
    df = articles(spark, [("u1", " 甲", ""), ("u1", "乙", ""), ("u2", "甲 ", ""), ("u3", "乙", "")])
    assert ids(dedup.by_link_then_title(df)) == [0, 3]


def test_link_or_title(spark):
    df = articles(spark, [("", "甲", ""), ("", "甲", ""), ("u" * 120, "x", ""), ("u" * 110, "y", "")])
    assert ids(dedup.by_url_or_title(df, n=100)) == [0, 2]
    assert ids(dedup.by_url_or_title(df)) == [0, 2, 3]


def merged_by_hand(rows, limit=None):
    """Sequential restatement of the merge rule for the test."""
    def alike(a, b):
        if a is None or b is None:
            return False
        a, b = a.lower(), b.lower()
        return a == b or (max(len(set(a)), len(set(b))) > 0 and len(set(a) & set(b)) / max(len(set(a)), len(set(b))) > 0.85)

    leaders, keys = [], set()
    for row in rows:
        if row["url"] in keys:
            continue
        hit = next((i for i, l in enumerate(leaders) if alike(l["title"], row["title"])), None)
        if hit is None:
            keys.add(row["url"])
            leaders.append(row)
        elif None not in (row["snippet"], leaders[hit]["snippet"]) and len(row["snippet"]) > len(leaders[hit]["snippet"]):
            leaders[hit] = row
    return leaders[:limit]


@pytest.mark.parametrize("fold_rows", [10_000, 25, 7])
def test_merge_similar_equals_the_sequential_rule(spark, fold_rows):
    """Also with lists longer than a fold takes, null groups and rows without a title or snippet."""
    rng = random.Random(fold_rows)
    rows = []
    for g, n in ((0, 70), (1, 3), (None, 40), (2, 25)):
        for i in range(n):
            letters = rng.choice(("甲乙丙丁戊己庚辛壬癸", "甲乙丙丁戊己庚辛壬癸abcdefgh"))
            rows.append({"g": g, "pos": i, "url": f"a.com/{rng.randint(0, n)}", "snippet": None if rng.random() < 0.04 else "s" * rng.randint(0, 30),
                         "title": None if rng.random() < 0.04 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))})
    df = spark.createDataFrame(rows, "g int, pos int, url string, title string, snippet string").repartition(5)
    got = dedup.merge_similar(df, ["g"], ["pos"], fold_rows=fold_rows)
    want = [(str(g), i, r["pos"]) for g in (0, 1, None, 2) for i, r in enumerate(merged_by_hand([x for x in rows if x["g"] == g]))]
    assert sorted((str(r["g"]), r["place"], r["pos"]) for r in got.collect()) == sorted(want)


def test_merge_is_one_pass_however_many_rows_change_the_list(spark):
    """No rounds: the number of jobs does not grow with the leaders, nor with the folds that a list takes."""
    def jobs(n):
        rows = [(i, f"a.com/{i}", "".join(map(chr, range(0x4E00 + 9 * i, 0x4E09 + 9 * i))), "s") for i in range(n)]
        df = spark.createDataFrame(rows, "pos int, url string, title string, snippet string").withColumn("g", F.lit(1))
        spark.sparkContext.setJobGroup(f"merge-{n}", "merge")
        try:
            assert dedup.merge_similar(df, ["g"], ["pos"], fold_rows=7).count() == n
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"merge-{n}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(140) == jobs(14) <= 20


@pytest.mark.parametrize("letters", [9, 60, 300, 4000])
def test_fold_equals_the_sequential_rule(letters, monkeypatch):
    """With fewer and more characters than a signature has bits, sets that are forgotten, and slices of all lengths."""
    import pyarrow as pa

    from newsgauge.operators import similar

    monkeypatch.setattr(similar, "SETS", 25)
    monkeypatch.setattr(similar, "_AHEAD", 5)
    monkeypatch.setattr(similar, "_PAIRS", 40)
    rng = random.Random(letters)
    bases = [[chr(0x4E00 + rng.randrange(letters)) for _ in range(rng.randint(0, 24))] for _ in range(12)]
    rows = []
    for i in range(400):
        title = [c for c in rng.choice(bases) if rng.random() > 0.04] + [chr(0x4E00 + rng.randrange(letters)) for _ in range(rng.randint(0, 2))]
        rows.append({"pos": i, "url": f"u{rng.randrange(300)}", "title": None if rng.random() < 0.03 else "".join(title),
                     "snippet": None if rng.random() < 0.03 else "s" * rng.randint(0, 60)})
    chars = similar.distinct_chars(pa.array([r["title"] for r in rows], pa.string()))
    assert [c and set(c) for c in chars.to_pylist()] == [r["title"] and set(r["title"]) for r in rows]
    done, at = similar.Fold(0.85), 0
    while at < len(rows):
        part = slice(at, at + rng.choice((1, 7, 60)))
        some = rows[part]
        sizes = pa.array([None if r["snippet"] is None else len(r["snippet"]) for r in some], pa.int32())
        done.rows(chars[part], pa.array([r["url"] for r in some]), sizes, pa.array([r["pos"] for r in some]))
        at += len(some)
    want = merged_by_hand(rows)
    assert done.ids == [r["pos"] for r in want] and len(want) > (3 if letters < 60 else 12)


def test_sets_are_compared_without_a_broadcast(spark):
    """Copies of sets are many times their stored size; characters of all planes keep apart."""
    from newsgauge.operators import similar

    chars = spark.createDataFrame([(["", "a", "中", "😀", "𠀀"],), (None,)], "chars array<string>").select(similar._code_points(F.col("chars")).alias("c"))
    assert [r["c"] for r in chars.collect()] == [[-1, ord("a"), ord("中"), ord("😀"), ord("𠀀")], None]
    sets = spark.createDataFrame([(0, [1, 2, 3]), (0, [7, 8, 9])], "g int, chars array<int>")
    others = spark.createDataFrame([(0, [1, 2, 3], 5), (1, [7, 8, 9], 6)], "g int, _chars array<int>, _idx long")
    pairs = similar._similar_sets(sets, others, ["g"], 0.85)
    assert [(r["chars"], r["_idx"]) for r in pairs.collect()] == [([1, 2, 3], 5)]
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_merge_compares_whole_links(spark):
    """Links that share their first 150 characters are one page only if asked for."""
    titles = ("某项目全面封顶", "无关的新闻标题", "完全不同内容", "另有一件事情")
    df = spark.createDataFrame([(i, "https://a.com/" + "p" * 150 + str(i), x, "") for i, x in enumerate(titles)], "pos int, url string, title string, snippet string").withColumn("g", F.lit(1))
    assert dedup.merge_similar(df, ["g"], ["pos"]).count() == 4
    assert dedup.merge_similar(df, ["g"], ["pos"], link_chars=150).count() == 1


def test_merge_searches_two_levels(spark):
    rng = random.Random(12)
    rows = []
    for q in range(3):
        for e in range(2):
            for i in range(60):
                rows.append({"keyword": "k", "query_rank": q, "engine_rank": e, "page_no": 0, "pos": i, "url": f"{q}{e}/{rng.randint(0, 40)}",
                             "title": "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(rng.randint(3, 12))), "snippet": "s" * rng.randint(0, 9),
                             "date": "", "media": ""})
    df = spark.createDataFrame(rows, "keyword string, query_rank int, engine_rank int, page_no int, pos int, url string, title string, snippet string, date string, media string")
    flat = []
    for q in range(3):
        flat += merged_by_hand([r for e in range(2) for r in rows if r["query_rank"] == q and r["engine_rank"] == e and r["pos"] < 40])
    want = [(r["query_rank"], r["engine_rank"], r["pos"]) for r in merged_by_hand(flat, 25)]
    got = dedup.merge_searches(df, 40, 25).orderBy("place").select("query_rank", "engine_rank", "pos").collect()
    assert [tuple(r) for r in got] == want


def test_whole_searches_beyond_a_fold_are_one_pass(spark):
    """A list with more rows than a fold reads at a time equals the sequential rule, without rounds of jobs."""
    rng = random.Random(3)
    bases = ["".join(rng.sample("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未", 9)) for _ in range(30)]
    rows = [{"keyword": "k", "query_rank": 0, "engine_rank": 0, "page_no": 0, "pos": i, "url": f"u{rng.randrange(9000)}", "title": rng.choice(bases) + rng.choice("申酉 "),
             "snippet": "s" * rng.randint(0, 40), "date": "", "media": ""} for i in range(10_050)]
    df = spark.createDataFrame(rows, "keyword string, query_rank int, engine_rank int, page_no int, pos int, url string, title string, snippet string, date string, media string")
    spark.sparkContext.setJobGroup("whole", "merge")
    try:
        got = dedup.merge_searches(df).orderBy("place").select("pos").collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole")) <= 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["pos"] for r in got] == [r["pos"] for r in merged_by_hand(merged_by_hand(rows))]


def test_longer_snippet_takes_the_place(spark):
    df = spark.createDataFrame(
        [(0, "a.com/1", "某项目全面封顶", "短"), (1, "b.com/2", "无关的新闻标题", ""), (2, "c.com/3", "某项目封顶全面", "长一些"), (3, "a.com/1", "另一个", ""), (4, "c.com/3", "再一个题", "")],
        "pos int, url string, title string, snippet string").withColumn("g", F.lit(1))
    got = dedup.merge_similar(df, ["g"], ["pos"]).orderBy("place").collect()
    # the place keeps the first row's link key: row 3 is still a repeat, row 4 is new
    assert [r["pos"] for r in got] == [2, 1, 4]


# --- score --------------------------------------------------------------------------------------------------

def scored(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, title string, snippet string, media string, url string, source string")
    return [(r["score"], r["score_detail"]) for r in score.with_score(df).orderBy("ord").collect()]


def test_score_rules(spark):
    got = scored(
        spark,
        ("某单位招聘公告", "", "m", "", "news"),
        ("2024-01-01", "", "m", "", "news"),
        ("正常标题在此处", "", "百度快照", "", "news"),
        ("四个字啊", "", "m", "", "news"),
        ("某项目全面封顶", "", "m", "u", "wechat"),
        ("某某某项目顺利通过验收——全面启用！", "摘要", "新华社", "http://www.x.gov.cn/a", "news"),
        ("普普通通标题", "", "某台", "https://news.cctv.com/1", "news"),
        ("普普通通标题", "", "某台", "http://bad host/", "other"),
        ("关于放假的通知", "", "m", "", "news"),
    )
    assert got[0] == (-100, ["绝对排除: " + v.EXCLUDE_PATTERNS[0]])
    assert got[1] == (-50, ["低质量源排除"]) and got[2] == (-50, ["低质量源排除"])
    assert got[3] == (0, ["标题过短(<5字)"])
    assert got[4] == (5 + 30 + 2 + 5, ["标题长度正常", "多事件词命中(2个)", "微信+事件词"])
    assert got[5] == (10 + 30 + 10 + 5 + 2 + 5 + 5 + 8, ["标题长度优(10-29字)", "多事件词命中(3个)", "进展描述+2", "新闻源", "正规媒体", "政府网站"])
    assert got[6] == (5 + 5 + 5 + 5, ["标题长度正常", "新闻源", "正规媒体", "知名媒体域名"])
    assert got[7] == (5, ["标题长度正常"])
    assert got[8] == (-100, ["绝对排除: " + v.EXCLUDE_PATTERNS[4]])


# --- tiers ----------------------------------------------------------------------------------------------------

def test_tiers(spark):
    dictionary = spark.createDataFrame([(0, "人民日报", "人民日报/央视"), (1, "新华", "中央级"), (2, "新华社上海", "地方"), (3, "融媒体", "地方")], "ord int, key string, value string")
    labels = spark.createDataFrame([("小号", "微信公众号"), ("某人说", "个人账号"), ("怪名", "没有的类"), ("新华", "个人账号")], "media string, category string")
    want = {
        "": "未分类", " 新华社上海 ": "地方", "新华社北京": "中央级", "报": "人民日报/央视", "融媒体": "地方", "News.CNR.cn": "央广",
        "太原日报": "地方", "山西晚报": "省部级", "某某日报": "人民日报/央视", "某新闻网": "省部级", "建筑时刊": "行业", "小号": "行业", "某人说": "个人账号",
        "怪名": "未分类", "没人知道": "未分类", "新华": "中央级",
    }
    want["某某日报"] = "省部级"
    df = spark.createDataFrame([(i, m) for i, m in enumerate(want)], "ord long, media string")
    got = {r["media"]: r["category"] for r in classify.with_category(df, "ord", dictionary, ("太原",), labels).collect()}
    assert got == want
    outlets = classify.classify_outlets(df.select("media").distinct(), dictionary, ("太原",), labels)
    assert sorted(r[0] for r in classify.unlabelled_outlets(outlets).collect()) == ["", "没人知道"]


# --- outlet correction ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("broadcast", [None, False])
def test_verification(spark, broadcast):
    rows = [
        (0, "news.cnr.cn", "https://x/0", "news"), (1, "搜狐", "https://news.cctv.com/1", "news"), (2, "搜狐", "https://s.com/2", "news"),
        (3, "搜狐", "https://s.com/2", "news"), (4, "未知来源", "https://s.com/4", "news"), (5, "搜狐", "https://s.com/2", "wechat"),
        (6, "光明日报", "https://s.com/6", "news"), (7, "标题_凤凰网", "https://s.com/7", "news"), (8, "搜狐", "ftp://s.com/8", "news"),
    ]
    df = spark.createDataFrame(rows, "ord long, media string, url string, source string")
    pad = " " * 1000
    pages = spark.createDataFrame([
        ("https://s.com/2", "https://final.com/2", '<meta name="mediaid" content="新华日报">' + pad),
        ("https://s.com/4", "", "来源：人民之声" + "安全验证" + pad),
        ("https://s.com/7", "https://news.google.com/x", '<meta name="source" content="搜狐新闻">' + pad),
    ], "url string, final_url string, html string")
    done = verify.correct_by_page(verify.flag_page_checks(verify.correct_by_domain(df)), pages, broadcast=broadcast)
    if broadcast is False:
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange" in line and "html" in line]
    got = {r["ord"]: (r["media"], r["url"], r["page_result"]) for r in done.collect()}
    assert got[0] == ("央广网", "https://x/0", None) and got[1][0] == "央视网"
    assert got[2] == ("新华日报", "https://final.com/2", "corrected") and got[3] == ("搜狐", "https://s.com/2", None)
    assert got[4] == ("未知来源", "https://s.com/4", "skipped") and got[5][0] == "搜狐" and got[6][0] == "光明日报"
    assert got[7] == ("搜狐新闻", "https://s.com/7", "corrected") and got[8] == ("搜狐", "ftp://s.com/8", None)
    assert tuple(verify.verification_stats(done).collect()[0]) == (3, 4, 1)


def test_resolve_links(spark):
    df = spark.createDataFrame([(0, "https://news.google.com/a"), (1, "https://news.google.com/b"), (2, "https://x")], "ord long, url string")
    known = spark.createDataFrame([("https://news.google.com/a", "https://real/a"), ("https://news.google.com/b", "https://news.google.com/c"), ("https://x", "https://y")], "url string, final_url string")
    got = {r["ord"]: r["url"] for r in verify.resolve_links(df, known).collect()}
    assert got == {0: "https://real/a", 1: "https://news.google.com/b", 2: "https://x"}


# --- reports --------------------------------------------------------------------------------------------------------

def test_positions_in_groups_of_any_size(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "ord long, g string, x double").repartition(6)
    got = {r["ord"]: r["position"] for r in with_position(df, [F.col("x").desc(), F.col("ord")], ["g"]).collect()}
    for g in ("hot", "a", "b", None):
        order = [o for o, k, x in sorted(rows, key=lambda r: (-r[2], r[0])) if k == g]
        assert [got[o] for o in order] == list(range(1, len(order) + 1))
    total = {r["ord"]: r["position"] for r in with_position(df, [F.col("x"), F.col("ord")]).collect()}
    assert [total[o] for o, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))] == list(range(1, 3001))


def test_rank_order(spark):
    rows = [(0, "行业", 50, "2024-01-01"), (1, "央广", 5, "2024-01-01"), (2, "央广", 5, "2024-02-01"), (3, "央广", 9, "2023-01-01"), (4, "奇怪", 99, ""), (5, "央广", 5, "2024-02-01")]
    df = spark.createDataFrame(rows, "ord long, category string, score int, date string")
    assert [r["ord"] for r in report.with_rank(df).orderBy("rank").collect()] == [3, 2, 5, 1, 0, 4]
    assert [r["ord"] for r in report.ranked(df).collect()] == [3, 2, 5, 1, 0, 4]


def test_reasons_sort_by_pinyin(spark):
    reasons = ["招聘求职", "报道评分不足", "专利公告", "广告推广"]
    df = spark.createDataFrame([(r,) for r in reasons], "filter_reason string")
    assert [r[0] for r in report.sort_rejected(df).collect()] == ["报道评分不足", "广告推广", "招聘求职", "专利公告"]


def test_summary_sheet_skips_empty_tiers(spark):
    df = spark.createDataFrame([("行业", "news"), ("央广", "wechat"), ("行业", "wechat"), ("个人账号", "news")], "category string, source string")
    got = [(r["item"], r["content"]) for r in report.summary_sheet(df, "甲", "2024-01-01", "2024-02-01").collect()]
    assert got == [("搜索关键词", "甲"), ("日期范围", "2024-01-01 至 2024-02-01"), ("发稿总数", "4"), ("", ""), ("===== 按媒体类别统计 =====", ""),
                   ("央广", "1"), ("行业", "2"), ("", ""), ("===== 按数据来源统计 =====", ""), ("多源新闻", "2"), ("微信公众号", "2")]


def test_projects_without_articles_count_zero(spark):
    asked = spark.createDataFrame([("a", "甲"), ("b", "乙")], "keyword string, project string")
    kept = spark.createDataFrame([("甲",), ("甲",)], "project string")
    got = {r["keyword"]: (r["n_kept"], r["n_raw"]) for r in report.count_by_project(asked, kept, kept).collect()}
    assert got == {"a": (2, 2), "b": (0, 0)}


@pytest.mark.parametrize("inline", [100, 0])
def test_blank_and_tied_keys_mean_the_same_in_both_plans(spark, inline):
    from newsgauge.operators.lookup import first_match, match_terms

    entries = spark.createDataFrame([(1, "", "EMPTY"), (2, "b", "B2"), (2, "a", "A2"), (3, "abc", "EXACT"), (1, "  ", "BLANK")], "ord int, key string, value string")
    names = spark.createDataFrame([("abc",), ("zzz",), ("xba",)], "name string")
    for both in (False, True):
        got = {r["name"]: r["value"] for r in first_match(names, "name", entries, both, inline).collect()}
        assert got == {"abc": "EXACT", "zzz": None, "xba": "A2"}
    articles = spark.createDataFrame([(1, "text b here"), (2, "other")], "id long, body string")
    terms = spark.createDataFrame([("",), ("b",), (" ",)], "term string")
    from pyspark.sql import functions as F

    got = [(r["id"], r["term"]) for r in match_terms(articles, F.col("body"), "id", terms, inline).collect()]
    assert got == [(1, "b")]


def test_common_reasons_and_scores_are_split_over_tasks(spark):
    from pyspark.sql import functions as F

    from newsgauge.operators import report, score

    rows = spark.range(20_000, numPartitions=4).select(F.col("id").alias("ord"), F.when(F.col("id") % 10 == 0, "甲").otherwise("乙").alias("filter_reason"), F.lit(20).alias("score"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (report.sort_rejected(rows), score.good_reports(rows)):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_long_counts_and_wide_blanks_in_relative_dates(apply):
    from newsgauge.functions.dates import normalise_date

    got = apply(lambda c: normalise_date(c, "2024-03-05T02:30:00"), ["1234567分钟前", "3　天前", "3 天前", "99999999999999999999天前", "9999999999天前"])
    assert got == ["2021-10-29", "2024-03-02", "2024-03-02", "99999999999999999999天前", "9999999999天前"]


@pytest.mark.parametrize("inline", [2000, 0])
def test_cities_come_from_a_table(spark, monkeypatch, inline):
    names = ["宁波晚报", "浙江日报", "某某日报", "浙江宁波日报", "宁波台"]
    outlets = spark.createDataFrame([(n,) for n in names], "media string")
    cities = spark.createDataFrame([("宁波",), ("", ), ("温州",)], "city string")
    monkeypatch.setattr(lookup, "INLINE_CHARS", inline)
    got = {r["media"]: r["category"] for r in classify.classify_outlets(outlets, cities=cities).collect()}
    want = {r["media"]: r["category"] for r in classify.classify_outlets(outlets, cities=("宁波", "温州")).collect()}
    assert got == want and got["宁波晚报"] == v.LOCAL and got["某某日报"] == v.PROVINCIAL


# --- numbering of narrow keys ---

def test_only_keys_are_ranked(spark, monkeypatch):
    """Wide columns are neither written nor sorted; starts of partitions are broadcast; rows without a group value count too."""
    from newsgauge.operators import position

    rows = [(i, None if i % 7 == 0 else f"g{i % 3}", i * 37 % 101, "w" * 50) for i in range(500)]
    df = spark.createDataFrame(rows, "ord long, g string, x int, wide string").repartition(6)
    written = []
    cut = position.cut
    monkeypatch.setattr(position, "cut", lambda d: written.append(d) or cut(d))
    out = with_position(df, [F.col("x").desc(), F.col("ord")], ["g"], row_id="ord", using=["x"])
    want = {}
    for g in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = (n, r[3])
    assert {r["ord"]: (r["position"], r["wide"]) for r in out.collect()} == want
    assert len(written) == 3 and not any("wide" in d.columns for d in written)
    joined = with_position(df.drop("wide"), [F.col("x"), F.col("ord")], ["g"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_numbered_files_follow_the_numbers(spark):
    from newsgauge.operators.position import in_files

    df = spark.range(1000).selectExpr("1000 - id AS n")
    parts = in_files(df, "n", 1000, 300).select("n", F.spark_partition_id().alias("p")).collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r["p"], []).append(r["n"])
    assert [n for p in sorted(by_part) for n in by_part[p]] == list(range(1, 1001)) and {len(x) for x in by_part.values()} == {250}
    assert in_files(df.limit(0), "n", 0).count() == 0


# --- redirects and first rows -----------------------------------------------------------------------------------

def test_redirect_chains(spark):
    """Chains of any length end at their page; circles and dead ends have no target."""
    from newsgauge.operators.verify import redirect_targets, resolve_links

    r = "https://news.google.com/rss/articles/{}".format
    chain = [(r(i), r(i + 1)) for i in range(20)] + [(r(20), "https://end.com/")]
    rest = [("https://a.com/", "https://b.com/"), (r("c1"), r("c2")), (r("c2"), r("c1")), (r("dead"), r("nowhere")), (r("self"), r("self")),
            (r("two"), r("c1")), (r("two"), "https://two.com/"), (r("none"), None)]
    resolved = spark.createDataFrame(chain + rest, "url string, final_url string")
    got = {x["url"]: x["final_url"] for x in redirect_targets(resolved).collect()}
    assert got == {**{r(i): "https://end.com/" for i in range(21)}, r("two"): "https://two.com/"}
    rows = spark.createDataFrame([(0, r(3)), (1, r("c1")), (2, "https://a.com/"), (3, None)], "ord long, url string")
    out = resolve_links(rows, resolved)
    assert {x["ord"]: x["url"] for x in out.collect()} == {0: "https://end.com/", 1: r("c1"), 2: "https://a.com/", 3: None}


def test_flag_first_shuffles_no_wide_rows(spark):
    """The only shuffle by key carries key, order and row id."""
    df = spark.range(1000).selectExpr("id AS ord", "cast(if(id < 700, 0, id % 50) AS string) AS k", "repeat('w', 100) AS wide", "1000 - id AS o")
    out = dedup.flag_first(df, [F.col("k")], [F.col("o")], "ord", among=F.col("ord") % 2 == 0)
    first = {}
    for i in sorted(range(0, 1000, 2), reverse=True):
        first.setdefault("0" if i < 700 else str(i % 50), i)
    assert sorted(r["ord"] for r in out.where("is_first").collect()) == sorted(first.values()) and out.count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line and "wide" in line]


# --- outlets kept between runs ---

def test_only_new_outlets_are_classified(spark, tmp_path, monkeypatch):
    dictionary = spark.createDataFrame([(0, "人民日报", "人民日报/央视"), (1, "新华", "中央级")], "ord int, key string, value string")
    names = ["新华社", "山西晚报", "", None, "没人知道", "某新闻网", "人民日报海外版"]
    table = lambda ns: spark.createDataFrame([(n,) for n in ns], "media string")
    asked = []
    rules = classify.rule_tiers
    monkeypatch.setattr(classify, "rule_tiers", lambda d, *a: asked.append({r[0] for r in d.collect()} - {None}) or rules(d, *a))
    tiers = lambda df: {r["media"]: r["rule"] for r in df.collect()}
    want = tiers(rules(table(names), dictionary))
    assert tiers(classify.stored_tiers(str(tmp_path), table(names[:3]), dictionary)) == {n: want[n] for n in names[:3]}
    assert tiers(classify.stored_tiers(str(tmp_path), table(names), dictionary)) == want
    files = sorted(tmp_path.rglob("*.parquet"))
    assert tiers(classify.stored_tiers(str(tmp_path), table(names[2:5]), dictionary)) == {n: want[n] for n in names[2:5]}
    assert [a for a in asked if a] == [set(names[:3]), {"没人知道", "某新闻网", "人民日报海外版"}]
    assert sorted(tmp_path.rglob("*.parquet")) == files
    # other rules have a folder of their own; the order of their rows does not matter
    assert classify.rules_version(dictionary) == classify.rules_version(dictionary.orderBy(F.desc("ord"))) != classify.rules_version(dictionary, ("大同",))
    more = dictionary.unionByName(table(["没人"]).selectExpr("2 AS ord", "media AS key", "'地方' AS value"))
    assert tiers(classify.stored_tiers(str(tmp_path), table(names), more))["没人知道"] == "地方"


# --- stored index ---------------------------------------------------------------------------------------------

ARTICLE_TEXTS = ["", None, "abc", "abcd", "xabcdx abcd", "中国建筑第八工程局", "建筑", "e", "ee e", "line one\nline two", "𝒳𝒴𝒵𝒲 plain", "100% _sure", "ab"]
TERMS = ["abcd", "abc", "ab", "b", "e", "建筑", "中国建筑第八", "建筑第八工程局", "nothing here", "zz", "one\nline", "𝒳𝒴", "𝒳𝒴𝒵𝒲 p", "%", "", "  ", None]


def indexed(spark, tmp_path, texts, part_rows):
    from newsgauge.operators import postings

    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    for name, part in (("a", df.where("ord % 3 = 0")), ("b", df.where("ord % 3 > 0")), ("a", df.where("ord % 3 = 0"))):
        postings.add_articles(part, F.col("text"), "ord", str(tmp_path), name, part_rows)
    return df


@pytest.mark.parametrize("part_rows", [2000, 2])
def test_indexed_terms_equal_a_scan(spark, tmp_path, part_rows):
    """Short, foreign, missing and blank terms; a term of two subjects; a batch that is written again."""
    from newsgauge.operators import postings

    indexed(spark, tmp_path, ARTICLE_TEXTS, part_rows)
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(TERMS)] + [(99, "abcd")], "subject int, term string")
    got = sorted(map(tuple, postings.match_indexed(spark, str(tmp_path), terms).select("id", "subject", "term").collect()))
    want = sorted((i, s, t) for i, text in enumerate(ARTICLE_TEXTS) for s, t in [*enumerate(TERMS), (99, "abcd")] if t and t.strip() and t in (text or ""))
    assert got == want and len(want) > 20
    assert postings.match_indexed(spark, str(tmp_path), terms.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [None, 2])
def test_search_by_index_equals_search_by_scan(spark, tmp_path, limit):
    from newsgauge.operators import postings
    from newsgauge.plans.search import search_indexed

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("甲乙丙丁") for _ in range(12)), f"2024-01-{i % 9 + 1:02d}", None if i % 5 == 0 else "摘要戊己", "old") for i in range(60)]
    articles = spark.createDataFrame(rows, "ord long, title string, date string, snippet string, keyword string")
    queries = spark.createDataFrame([("k", 0, 0, "甲乙"), ("k", 0, 1, "戊己"), ("l", 1, 0, "甲乙丙丁甲"), ("l", 1, 1, "无")], "keyword string, keyword_rank int, query_rank int, term string")
    postings.add_articles(articles, F.concat("title", F.coalesce("snippet", F.lit(""))), "ord", str(tmp_path), "all", 7)
    columns = ["keyword", "query_rank", "term", "ord", "pos", "title", "date"]
    by_index = search_indexed(articles, str(tmp_path), queries, limit).select(*columns)
    by_scan = search_articles(articles, queries, limit).select(*columns)
    assert sorted(map(tuple, by_index.collect())) == sorted(map(tuple, by_scan.collect())) and by_scan.count() > 3


def test_a_search_opens_few_files(spark, tmp_path):
    """Files of other grams and of parts without candidates are spoilt; the search does not read them."""
    import pathlib

    from newsgauge.operators import postings

    rng = random.Random(8)
    texts = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(60)) for _ in range(400)]
    texts[17] += "子丑寅卯辰"
    indexed(spark, tmp_path, texts, 10)
    slots = {r[0] for r in spark.createDataFrame([("子丑寅卯",), ("丑寅卯辰",)], "g string").select(postings._slot(F.col("g"))).collect()}
    parts = {(r["batch"], r["shelf"]) for r in postings._read(spark, str(tmp_path), "texts").where("id = 17").collect()}
    size = kept = 0
    for f in pathlib.Path(tmp_path).rglob("*.parquet"):
        at = dict(p.split("=") for p in f.parts if "=" in p)
        needed = int(at["slot"]) in slots if "slot" in at else (at["batch"], int(at["shelf"])) in parts or int(at["shelf"]) in {s for _, s in parts}
        size, kept = size + f.stat().st_size, kept + needed * f.stat().st_size
        if not needed:
            f.with_name("." + f.name + ".crc").unlink(missing_ok=True)
            f.write_bytes(b"spoilt")
    got = postings.match_indexed(spark, str(tmp_path), spark.createDataFrame([("子丑寅卯辰",)], "term string")).collect()
    assert [r["id"] for r in got] == [17] and kept < size / 5


@pytest.mark.parametrize("gather", [8_000_000, 20])
def test_postings_of_a_part_are_gathered_where_its_texts_are_read(spark, monkeypatch, gather):
    """Every gram of every text once, with the texts' places, against a plain count; characters of all widths, and too many for one number."""
    import pyarrow as pa

    from newsgauge.operators import postings

    monkeypatch.setattr(postings, "GATHER_CHARS", gather)
    rng = random.Random(5)
    wide = "".join(map(chr, range(0x4E00, 0x9000))) + "".join(map(chr, range(0xAC00, 0xD7A0)))
    texts = ["", "e", "abcabc", "é€𝒳𝒴𝒵", "a\x00b", *("".join(rng.choice("abé€𝒳 ") for _ in range(30)) for _ in range(20)), wide, wide[::-1]]
    rows = [(i // 9, i % 9 + 1, x) for i, x in enumerate(texts)]
    cells = [pa.array(c) for c in zip(*rows, strict=True)]
    batches = [pa.RecordBatch.from_arrays([c.slice(i, 4) for c in cells], ["part", "place", "text"]) for i in range(0, len(rows), 4)]
    got = [(r["gram"], r["part"], p) for b in postings._posting_rows(iter(batches)) for r in b.to_pylist() for p in r["places"]]
    want = {((x + "\0\0\0")[i : i + 4], part, place) for part, place, x in rows for i in range(len(x)) if x[i] != "\0"}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_stored_index_shuffles_no_row_for_each_gram_of_a_text(spark, tmp_path, monkeypatch):
    """Grams meet where the texts of a part are read: of the postings only whole rows are dealt, once, and bounds need no second run."""
    from pyspark.sql.readwriter import DataFrameWriter

    from newsgauge.operators import postings

    plans, write = {}, DataFrameWriter.parquet

    def noted(self, path, *a, **b):
        plans[path.removeprefix(str(tmp_path))] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    df = spark.createDataFrame([(i * 1_000_003 + 2**40, f"text {i % 7} of {i}") for i in range(50)], "ord long, text string")
    postings.add_articles(df, F.col("text"), "ord", str(tmp_path), "all", 10)
    dealt, texts = plans["/postings/batch=all"], plans["/texts/batch=all"]
    assert "Aggregate" not in dealt and dealt.count("Exchange") == 1 and "rangepartitioning" not in dealt + texts
    monkeypatch.undo()
    got = postings.match_indexed(spark, str(tmp_path), spark.createDataFrame([("text 3 of",)], "term string")).collect()
    assert sorted(r["id"] for r in got) == [i * 1_000_003 + 2**40 for i in range(50) if i % 7 == 3]
