"""Keywords: clean-up, resolution to subjects, search queries and match terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.text import anchored, trim_ws

_NO_TEXTS = "cast(array() as array<string>)"


def clean_keywords(df: DataFrame, keyword: str = "keyword", rank: str = "keyword_rank") -> DataFrame:
    """Trimmed, non-blank, distinct keywords, each with its first rank."""
    return (
        df.select(trim_ws(F.col(keyword)).alias(keyword), rank)
        .where(F.col(keyword) != "")
        .groupBy(keyword)
        .agg(F.min(rank).alias(rank))
    )


def subject_names(subjects: DataFrame) -> DataFrame:
    """Every name a subject answers to, with its match score: primary 100, alias 90, term 80."""
    cols = ["ord", "primary", "aliases", "terms"]
    base = subjects.select(*cols)
    return (
        base.select("*", F.col("primary").alias("name"), F.lit(100).alias("score"))
        .unionByName(base.select("*", F.explode("aliases").alias("name"), F.lit(90).alias("score")))
        .unionByName(base.select("*", F.explode("terms").alias("name"), F.lit(80).alias("score")))
    )


def keyword_matches(keywords: DataFrame, subjects: DataFrame) -> DataFrame:
    """All subjects a keyword names exactly, with the best score per subject."""
    names = subject_names(subjects).withColumnRenamed("name", "_name")
    hits = keywords.join(names, F.col("keyword") == F.col("_name"))
    return hits.groupBy("keyword", "primary", "ord").agg(F.max("score").alias("score"))


def resolve_keywords(keywords: DataFrame, subjects: DataFrame) -> DataFrame:
    """Add ``subject`` (struct, NULL for a literal keyword), ``score`` and ``project`` to each keyword.

    Best score wins, then the earlier subject.
    """
    names = subject_names(subjects).withColumnRenamed("name", "_name")
    hits = keywords.select("keyword").join(names, F.col("keyword") == F.col("_name"))
    best = hits.groupBy("keyword").agg(
        F.max_by(
            F.struct("primary", "aliases", "terms"), F.struct(F.col("score"), -F.col("ord"))
        ).alias("subject"),
        F.max("score").alias("score"),
    )
    return keywords.join(best, "keyword", "left").withColumn(
        "project", F.coalesce(F.col("subject.primary"), F.col("keyword"))
    )


def search_queries(keyword: Column, subject: Column) -> Column:
    """Search strings for a keyword, most specific first, at most eight."""
    primary = subject["primary"]
    of_subject = F.concat(
        F.filter(F.slice(subject["terms"], 1, 4), lambda x: F.length(x) >= 6),
        F.array(primary),
        F.slice(subject["aliases"], 1, 4),
        F.array(
            F.concat(primary, F.lit(" " + " ".join(v.NEWS_WORDS))),
            F.when(F.length(primary) <= 6, F.concat(F.lit(v.COMPANY_QUERY_PREFIX + " "), primary)),
        ),
    )
    queries = F.concat(F.coalesce(of_subject, F.expr(_NO_TEXTS)), F.array(trim_ws(keyword)))
    return F.slice(F.array_distinct(F.array_compact(queries)), 1, v.QUERIES_PER_SUBJECT)


def core_name(keyword: Column) -> Column:
    """Keyword without trailing words such as 项目 or 工程."""
    return F.regexp_replace(keyword, anchored(v.SUBJECT_TAIL), "")


def literal_variants(keyword: Column) -> Column:
    """Spellings under which a literal keyword counts as mentioned."""
    core = core_name(keyword)
    stripped = (core != "") & (core != keyword)
    no_province = F.replace(core, F.lit("省"), F.lit(""))
    return F.array_distinct(
        F.array_compact(
            F.array(
                keyword,
                F.when(stripped, core),
                F.when(stripped, F.concat(core, F.lit("项目"))),
                F.when(stripped, F.concat(core, F.lit("工程"))),
                F.when((no_province != core) & (F.length(no_province) >= 6), no_province),
            )
        )
    )


def co_occurrence(keyword: Column) -> Column:
    """[region, core] for a keyword that starts with a province; NULL otherwise."""
    pattern = anchored(v.PROVINCE_LEAD)
    region = F.regexp_replace(F.regexp_extract(keyword, pattern, 1), r"省\z", "")
    core = core_name(F.regexp_extract(keyword, pattern, 2))
    return F.when((region != "") & (F.length(core) >= 5), F.array(region, core))


def plan_searches(resolved: DataFrame) -> DataFrame:
    """Add queries and match terms to resolved keywords.

    A subject is searched by its generated queries and matched by its terms (its name if it has
    none); a literal keyword by its variants, where region and core apart also count.
    """
    subject, keyword = F.col("subject"), F.col("keyword")
    known = subject.isNotNull()
    variants = literal_variants(keyword)
    return resolved.select(
        "*",
        F.when(known, search_queries(keyword, subject))
        .otherwise(F.slice(variants, 1, v.LITERAL_QUERIES_USED))
        .alias("queries"),
        F.slice(search_queries(F.col("project"), subject), 1, v.QUERIES_USED).alias("wechat_queries"),
        F.when(known & (F.size("subject.terms") > 0), F.col("subject.terms"))
        .when(known, F.array("subject.primary"))
        .otherwise(variants)
        .alias("match_terms"),
        F.when(~known, co_occurrence(keyword)).alias("co_occur"),
    )


def query_rows(planned: DataFrame, column: str = "queries", used: int = v.QUERIES_USED) -> DataFrame:
    """One row per keyword and query actually used, with its rank."""
    return planned.select(
        "keyword", "keyword_rank", F.posexplode(F.slice(column, 1, used)).alias("query_rank", "term")
    )
