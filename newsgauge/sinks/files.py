"""Report files. Every writer is a distributed Spark write into a folder.

All fields that need it are quoted and inner quotes doubled, so any title survives a round trip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.operators.position import in_files
from newsgauge.operators.report import report_order, with_rank

_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
READ_CSV = {**_CSV, "multiLine": True}


def kept_columns(df: DataFrame, numbered: bool = True) -> DataFrame:
    lead = [F.col("rank").alias("序号")] if numbered else []
    return df.select(
        *lead,
        F.col("date").alias("日期"),
        F.col("title").alias("文章标题"),
        F.col("media").alias("刊发媒体"),
        F.col("category").alias("媒体类别"),
        F.col("url").alias("媒体链接"),
        F.coalesce("snippet", F.lit("")).alias("摘要"),
    )


def scored_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("date").alias("日期"),
        F.coalesce("project", F.lit("")).alias("项目"),
        F.col("title").alias("文章标题"),
        F.col("media").alias("刊发媒体"),
        F.col("category").alias("媒体类别"),
        F.col("score").alias("报道评分"),
        F.col("url").alias("媒体链接"),
    )


def rejected_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("filter_reason").alias("过滤原因"),
        F.col("date").alias("日期"),
        F.coalesce("project", F.lit("")).alias("项目"),
        F.col("title").alias("文章标题"),
        F.col("media").alias("刊发媒体"),
        F.col("url").alias("媒体链接"),
    )


def write_kept_csv(df: DataFrame, path: str, row_id: str = "ord") -> None:
    """Numbered article list in report order; the part files follow the numbering, none of them for one task too large to read back."""
    texts = ("date", "title", "media", "category", "url", "snippet")
    length = reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts])
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    kept_columns(in_files(with_rank(df, row_id=row_id), "rank", rows, size=size)).write.options(**_CSV).csv(path)


def write_scored_csv(df: DataFrame, path: str, row_id: str = "ord") -> None:
    """Report order, with project and score instead of number and snippet."""
    scored_columns(df.orderBy(*report_order(row_id))).write.options(**_CSV).csv(path)


def write_rejected_csv(df: DataFrame, path: str) -> None:
    """Rejected articles, one folder per reason; each task writes its own rows, so no reason gathers."""
    rows = rejected_columns(df).withColumn("reason", F.col("过滤原因"))
    rows.write.partitionBy("reason").options(**_CSV).csv(path)


def write_tsv(df: DataFrame, path: str, row_id: str = "ord") -> None:
    """Plain tab-separated dump in report order; tabs and line breaks inside fields become blanks."""
    fields = ["date", "project", "title", "media", "category", "url"]
    flat = df.orderBy(*report_order(row_id)).select(
        F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ") for c in fields]).alias("value")
    )
    flat.write.text(path)
