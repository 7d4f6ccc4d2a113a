from newsgauge.operators import report
from newsgauge.sinks import files
from newsgauge.streaming import landing

COLS = "ord long, date string, title string, media string, category string, url string, snippet string, project string, score int, filter_reason string"
ROWS = [
    (0, "2024-01-01", '带"引号", 和逗号', "甲,乙报", "行业", "https://a/1?x=1,2", "第一行\n第二行", "p", 5, "广告推广"),
    (1, "2024-01-02", "普通", "丙", "央广", "https://a/2", "", "p", 9, "招聘求职"),
    (2, "", "制表\t符", "丁", "行业", "u", None, None, 7, "广告推广"),
]


def test_kept_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLS)
    files.write_kept_csv(df, str(tmp_path / "kept"))
    back = spark.read.options(**files.READ_CSV).csv(str(tmp_path / "kept")).orderBy("序号").collect()
    assert [r["文章标题"] for r in back] == ["普通", "制表\t符", '带"引号", 和逗号']
    assert back[2]["摘要"] == "第一行\n第二行" and back[2]["刊发媒体"] == "甲,乙报"
    assert [r["序号"] for r in back] == ["1", "2", "3"]


def test_rejected_csv_has_a_folder_per_reason(spark, tmp_path):
    files.write_rejected_csv(spark.createDataFrame(ROWS, COLS), str(tmp_path / "rej"))
    back = spark.read.options(**files.READ_CSV).csv(str(tmp_path / "rej"))
    assert {r["过滤原因"] for r in back.collect()} == {"广告推广", "招聘求职"}
    assert len(list((tmp_path / "rej").glob("reason=*"))) == 2


def test_tsv_in_report_order(spark, tmp_path):
    files.write_tsv(spark.createDataFrame(ROWS, COLS).coalesce(1), str(tmp_path / "tsv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "tsv")).collect()]
    assert "\t\t制表 符\t丁\t行业\tu" in lines and len(lines) == 3


def test_scored_csv(spark, tmp_path):
    files.write_scored_csv(spark.createDataFrame(ROWS, COLS), str(tmp_path / "s"))
    back = spark.read.options(**files.READ_CSV).csv(str(tmp_path / "s")).collect()
    assert {r["报道评分"] for r in back} == {"5", "7", "9"}


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    bodies = [f"<item><title>第{i}条新闻标题{'招聘' if i % 3 == 0 else ''}</title><link>https://a/{i % 4}</link></item>" + " " * 200 for i in range(9)]
    rows = [("rss", f"k{i % 2}", 0, 0, i, b) for i, b in enumerate(bodies)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "engine string, keyword string, keyword_rank int, query_rank int, page_no int, body string")
    df.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS fetched_at").repartition(3).write.parquet(src)

    stream = landing.parse_landing(landing.read_landing(spark, src, max_files=1), "rss", "2024-01-01")
    q = landing.count_increments(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["dimension"], r["key"]): r["n"] for r in landing.read_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {("k0", "kept"): 3, ("k0", "招聘求职"): 2, ("k1", "kept"): 3, ("k1", "招聘求职"): 1}

    unique = landing.first_seen(landing.parse_landing(landing.read_landing(spark, src), "rss", "2024-01-01"))
    q = unique.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 4


def test_partials_add_up(spark):
    parts = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 3)], "dimension string, key string, n long")
    assert sorted(tuple(r) for r in report.merge_partials(parts).collect()) == [("a", "x", 3), ("b", "x", 3)]


def test_landed_articles_prune_folders(spark, tmp_path):
    from newsgauge.sources.landed import read_articles, write_articles

    rows = [(0, "2024-01-01", "news"), (1, "2024-02-01", "news"), (2, "", "news"), (3, "5天前", "wechat"), (4, "2024-02-30", "news"), (5, "2024-01-15", "wechat")]
    df = spark.createDataFrame(rows, "ord long, date string, source string")
    write_articles(df, str(tmp_path / "a"))
    got = read_articles(spark, str(tmp_path / "a"), "2024-01-01", "2024-01-31")
    assert sorted(r["ord"] for r in got.collect()) == [0, 2, 3, 4, 5]
    news = read_articles(spark, str(tmp_path / "a"), "2024-01-01", "2024-01-31", "news")
    assert sorted(r["ord"] for r in news.collect()) == [0, 2, 4]
    plan = news._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "source" in filters and "day" in filters


def test_kept_csv_parts_follow_the_numbering(spark, tmp_path):
    import csv

    rows = [(i, f"2024-01-{i % 28 + 1:02d}", f"t{i}", "m", "行业", "u", "s", "p", i % 7, None) for i in range(500)]
    files.write_kept_csv(spark.createDataFrame(rows, COLS).repartition(4), str(tmp_path / "kept"))
    numbers = []
    for part in sorted((tmp_path / "kept").glob("part-*")):
        with part.open(encoding="utf-8") as f:
            numbers += [int(r["序号"]) for r in csv.DictReader(f)]
    assert numbers == list(range(1, 501))


def test_kept_csv_splits_long_rows(spark, tmp_path, monkeypatch):
    """Few rows with long texts are no single file, which one task would have to read back."""
    import csv

    from newsgauge.operators import position

    rows = [(i, "2024-01-01", f"t{i}", "m", "行业", "u", "s" * 1000, "p", 1, None) for i in range(100)]
    monkeypatch.setattr(position.in_files, "__defaults__", (position.FILE_ROWS, 0, 25_000))
    files.write_kept_csv(spark.createDataFrame(rows, COLS).repartition(4), str(tmp_path / "kept"))
    numbers = []
    parts = sorted((tmp_path / "kept").glob("part-*"))
    for part in parts:
        with part.open(encoding="utf-8") as f:
            numbers += [int(r["序号"]) for r in csv.DictReader(f)]
    assert len(parts) >= 4 and numbers == list(range(1, 101))
