"""Explainable report-quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.text import anchored, any_of, bind, matches
from newsgauge.functions.urls import host
from newsgauge.operators.lookup import constant_array


def words_contained(text: Column, words) -> Column:
    """Number of list entries the text contains; nested entries count each."""
    entries = constant_array([{"w": w} for w in words], "w:string")
    return bind(text, lambda x: F.size(F.filter(entries, lambda e: F.contains(x, e["w"]))))


def excluded_by(title: Column, text: Column, patterns=v.EXCLUDE_PATTERNS) -> Column:
    """First exclusion pattern found in the title or the text, else NULL."""

    def first(whole: Column) -> Column:
        # an anchored pattern may match the title alone; the others match the text if they match the title
        return F.coalesce(
            *[F.when(matches(title, p) | matches(whole, p) if p.startswith("^") else matches(whole, p), p) for p in patterns]
        )

    return bind(text, first)


def is_low_quality(title: Column, media: Column, patterns=v.LOW_QUALITY_PATTERNS) -> Column:
    p = "|".join(f"(?:{anchored(x)})" for x in patterns)
    return title.rlike(p) | media.rlike(p)


def length_points(title: Column) -> Column:
    n = F.length(title)
    return F.when(n.between(10, 29), 10).when(n.between(5, 39), 5).otherwise(0)


def event_points(hits: Column) -> Column:
    return F.when(hits >= 2, 30).when(hits == 1, 20).otherwise(0)


def progress_points(hits: Column) -> Column:
    return F.when(hits >= 2, 10).otherwise(0)


def structure_points(title: Column) -> Column:
    return F.when(title.rlike("[-—:：]"), 5).otherwise(0) + F.when(title.rlike("[！!]"), 2).otherwise(0)


def is_formal_outlet(media: Column) -> Column:
    return media.rlike(r"[报网台刊社]\z|新华|人民|央视")


def source_points(source: Column, media: Column, event_hits: Column) -> Column:
    return (
        F.when(source == "news", F.lit(5) + F.when(is_formal_outlet(media), 5).otherwise(0))
        .when(source == "wechat", F.lit(2) + F.when(event_hits > 0, 5).otherwise(0))
        .otherwise(0)
    )


def _link_host(url: Column) -> Column:
    return host(F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url)))


def is_government(url: Column) -> Column:
    return F.contains(_link_host(url), F.lit(".gov.cn"))


def is_known_news(url: Column) -> Column:
    return _link_host(url).rlike(any_of(v.KNOWN_NEWS_DOMAINS))


def url_points(url: Column) -> Column:
    return F.when(is_government(url), 8).otherwise(0) + F.when(is_known_news(url), 5).otherwise(0)


def with_score(df: DataFrame, exclude=v.EXCLUDE_PATTERNS, low_quality=v.LOW_QUALITY_PATTERNS,
               event_words=v.EVENT_WORDS, progress_words=v.PROGRESS_WORDS) -> DataFrame:
    """Add ``score`` and ``score_detail``, the rules that gave points, in rule order."""
    title, media = F.col("title"), F.coalesce(F.col("media"), F.lit(""))
    source, url = F.col("source"), F.coalesce(F.col("url"), F.lit(""))
    text = F.concat(title, F.coalesce(F.col("snippet"), F.lit("")))
    # plain columns, not a struct: the optimizer would inline a struct's fields into every use
    f = {
        "excluded": excluded_by(title, text, exclude),
        "low": is_low_quality(title, media, low_quality),
        "chars": F.length(title),
        "events": words_contained(title, event_words),
        "progress": words_contained(title, progress_words),
        "formal": is_formal_outlet(media) & (source == "news"),
        "gov": is_government(url),
        "known": is_known_news(url),
    }
    facts = df.select("*", *[c.alias(f"_{n}") for n, c in f.items()])
    f = {n: F.col(f"_{n}") for n in f}
    points = (
        length_points(title)
        + event_points(f["events"])
        + progress_points(f["progress"])
        + structure_points(title)
        + source_points(source, media, f["events"])
        + F.when(f["gov"], 8).otherwise(0)
        + F.when(f["known"], 5).otherwise(0)
    )
    detail = F.array_compact(
        F.array(
            F.when(f["chars"].between(10, 29), v.DETAIL_GOOD_TITLE).when(
                f["chars"].between(5, 39), v.DETAIL_OK_TITLE
            ),
            F.when(
                f["events"] >= 2,
                F.concat(F.lit(v.DETAIL_EVENTS[0]), f["events"].cast("string"), F.lit(v.DETAIL_EVENTS[1])),
            ).when(f["events"] == 1, v.DETAIL_EVENT),
            F.when(f["progress"] >= 2, F.concat(F.lit(v.DETAIL_PROGRESS), f["progress"].cast("string"))),
            F.when(source == "news", v.DETAIL_NEWS),
            F.when(f["formal"], v.DETAIL_FORMAL),
            F.when((source == "wechat") & (f["events"] > 0), v.DETAIL_WECHAT),
            F.when(f["gov"], v.DETAIL_GOV),
            F.when(f["known"], v.DETAIL_KNOWN),
        )
    )
    too_short = f["chars"] < 5
    return facts.select(
        *df.columns,
        F.when(f["excluded"].isNotNull(), v.EXCLUDE_SCORE)
        .when(f["low"], v.LOW_QUALITY_SCORE)
        .when(too_short, 0)
        .otherwise(points)
        .cast("int")
        .alias("score"),
        F.when(f["excluded"].isNotNull(), F.array(F.concat(F.lit(v.DETAIL_EXCLUDED), f["excluded"])))
        .when(f["low"], F.array(F.lit(v.DETAIL_LOW_QUALITY)))
        .when(too_short, F.array(F.lit(v.DETAIL_SHORT_TITLE)))
        .otherwise(detail)
        .alias("score_detail"),
    )


def good_reports(df: DataFrame, min_score: int = v.MIN_REPORT_SCORE, row_id: str = "ord") -> DataFrame:
    """Scored rows at or above the threshold, best first, equal ones by ``row_id``, so that one score is split over tasks."""
    return df.where(F.col("score") >= min_score).orderBy(F.col("score").desc(), *([F.col(row_id)] if row_id in df.columns else []))


def score_stats(scored: DataFrame) -> DataFrame:
    s = F.col("score")
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if(s >= 30).alias("high"),
        F.count_if(s.between(15, 29)).alias("ok"),
        F.count_if(s.between(1, 14)).alias("low"),
        F.count_if(s <= 0).alias("excluded"),
    )
