"""Ranking and summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.text import display_label
from newsgauge.operators.classify import tier_rank
from newsgauge.operators.joins import attach
from newsgauge.operators.position import with_position


# --- order -------------------------------------------------------------------------------------------

def report_order(row_id: str = "ord") -> list[Column]:
    """Tier, then score and date downwards; the row id settles ties."""
    return [
        tier_rank(F.col("category")).asc(),
        F.coalesce(F.col("score"), F.lit(0)).desc(),
        F.col("date").desc(),
        F.col(row_id).asc(),
    ]


def ranked(df: DataFrame, row_id: str = "ord") -> DataFrame:
    return df.orderBy(*report_order(row_id))


def with_rank(df: DataFrame, group: list[str] | None = None, row_id: str = "ord", name: str = "rank") -> DataFrame:
    """Place of each article in the report, or in its group's part of it."""
    return with_position(df, report_order(row_id), group, name, row_id, ("category", "score", "date"))


def by_project(df: DataFrame, keywords: DataFrame, row_id: str = "ord") -> DataFrame:
    """Every requested keyword with its articles in report order; keywords without articles keep one
    row with NULLs."""
    placed = with_rank(df, ["project"], row_id).drop("keyword", "keyword_rank")
    # a project asked for by several keywords is listed once, under the first of them
    asked = keywords.groupBy("project").agg(F.min(F.struct("keyword_rank", "keyword")).alias("_first"))
    asked = asked.select("_first.keyword", "_first.keyword_rank", "project")
    # an outer join could not split a hot project, so the two cases are joined apart
    listed = attach(placed, asked, "project", row_id, how="inner")
    empty = asked.join(df.select("project").distinct(), "project", "left_anti")
    return listed.unionByName(empty, allowMissingColumns=True)


def sort_rejected(df: DataFrame, reason: str = "filter_reason", row_id: str = "ord") -> DataFrame:
    """Rejected rows by reason in Chinese collation, then by ``row_id`` where there is one, so that a common
    reason is split over tasks."""
    ties = [F.col(row_id)] if row_id in df.columns else []
    return df.orderBy(F.collate(F.col(reason), "zh"), *ties)


def rejected_sample(df: DataFrame, order: list[Column], n: int = v.FILTERED_SAMPLE) -> DataFrame:
    """The first ``n`` rejected rows; totals are counted apart and stay exact."""
    return df.orderBy(*order).limit(n)


# --- counts ------------------------------------------------------------------------------------------

def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def totals(df: DataFrame, shown: Column) -> DataFrame:
    """The number of rows, and of those that are shown."""
    return df.agg(F.count("*").alias("total"), F.count_if(shown).alias("shown"))


def source_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("source") == "news").alias("news"),
        F.count_if(F.col("source") != "news").alias("wechat"),
    )


def count_by_project(keywords: DataFrame, kept: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Final (and raw) article counts per keyword; keywords without articles count 0."""
    out = keywords.select("keyword", "project")
    out = out.join(count_by(kept, "project", "n_kept"), "project", "left")
    if raw is not None:
        out = out.join(count_by(raw, "project", "n_raw"), "project", "left")
    counts = [c for c in ("n_kept", "n_raw") if c in out.columns]
    return out.select("keyword", "project", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


#: Stages of the funnel in which a row may be rejected, in order; later ones are ``final``.
STAGES = ("content", "precision", "dedup", "score")


def funnel_counts(df: DataFrame, group: str = "project") -> DataFrame:
    """Rows left after each stage, from rows with the ``stage`` that rejected them (NULL: none)."""
    stage = F.coalesce(F.col("stage"), F.lit(""))
    left = [F.count_if(~stage.isin(list(STAGES[: i + 1]))).alias(f"after_{s}") for i, s in enumerate(STAGES)]
    return df.groupBy(group).agg(F.count("*").alias("in_range"), *left)


def report_stats(rows: DataFrame, dims=("category", "source", "project", "filter_reason")) -> DataFrame:
    """All summaries in one pass: (dimension, key, n), with the grand total under ``total``.

    ``rows`` holds kept and rejected articles; a dimension counts the rows where it is not NULL, so
    leave ``category`` NULL on rejected rows and ``filter_reason`` NULL on kept ones.
    """
    sets = [[F.col(d)] for d in dims] + [[]]
    counted = rows.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n")
    )
    total = (1 << len(dims)) - 1
    which = reduce(
        lambda acc, it: acc.when(F.col("_g") == total - (1 << (len(dims) - 1 - it[0])), it[1]), enumerate(dims), F
    ).otherwise("total")
    key = F.coalesce(*[F.col(d).cast("string") for d in dims])
    named = counted.select(which.alias("dimension"), key.alias("key"), "n")
    return named.where("dimension = 'total' OR key IS NOT NULL").select(
        "dimension", F.coalesce("key", F.lit("")).alias("key"), "n"
    )


def merge_partials(partials: DataFrame, keys=("dimension", "key"), value: str = "n") -> DataFrame:
    """Add up stored partial counts, for example one table per day or per request."""
    return partials.groupBy(*keys).agg(F.sum(value).alias(value))


# --- report sheets -----------------------------------------------------------------------------------

def source_label(source: Column) -> Column:
    return F.when(source == "news", v.SOURCE_LABELS["news"]).otherwise(v.SOURCE_LABELS["wechat"])


def article_sheet(df: DataFrame, row_id: str = "ord") -> DataFrame:
    """Numbered article list of the report."""
    return with_rank(df, row_id=row_id, name="序号").select(
        "序号",
        F.col("date").alias("日期"),
        F.col("title").alias("文章标题"),
        F.col("media").alias("刊发媒体"),
        F.col("category").alias("媒体类别"),
        F.col("url").alias("媒体链接"),
        F.col("snippet").alias("摘要"),
        source_label(F.col("source")).alias("数据来源"),
    )


def summary_sheet(df: DataFrame, keyword: str, date_from: str, date_to: str) -> DataFrame:
    """Key/value summary: request, total, tiers in fixed order without empty ones, then sources."""
    news, accounts = v.SOURCE_LABELS["news"], v.SOURCE_LABELS["wechat"]
    lines = [
        (1, "搜索关键词", keyword, None), (2, "日期范围", f"{date_from} 至 {date_to}", None), (3, "发稿总数", None, 0),
        (4, "", "", None), (5, "===== 按媒体类别统计 =====", "", None),
        (90, "", "", None), (91, "===== 按数据来源统计 =====", "", None), (92, news, None, 0), (93, accounts, None, 0),
    ]
    fixed = df.sparkSession.createDataFrame(lines, "seq int, item string, content string, n long")
    # one pass for the total, the tiers and the sources; the fixed lines supply the zeros
    counted = report_stats(df.select("category", source_label(F.col("source")).alias("source")), ("category", "source"))
    tier = reduce(lambda acc, it: acc.when(F.col("key") == it[1], 10 + it[0]), enumerate(v.SUMMARY_TIERS), F)
    seq = (
        F.when(F.col("dimension") == "total", 3)
        .when(F.col("dimension") == "category", tier)
        .when(F.col("key") == news, 92)
        .otherwise(93)
    )
    counted = counted.select(
        seq.alias("seq"),
        F.when(F.col("dimension") == "total", "发稿总数").otherwise(F.col("key")).alias("item"),
        F.lit(None).cast("string").alias("content"),
        "n",
    )
    return (
        fixed.unionByName(counted.where("seq IS NOT NULL"))
        .groupBy("seq", "item")
        .agg(F.coalesce(F.max("content"), F.sum("n").cast("string")).alias("content"))
        .orderBy("seq")
    )


def tier_cards(df: DataFrame) -> DataFrame:
    """Counts by tier under their display labels."""
    return count_by(df, "category").select(display_label(F.col("category")).alias("label"), "n")
