"""Incremental coverage counts over a landing folder.

A batch run of one day and the sum of that day's increments give the same counts: payload parsing and
the noise rules look at one row at a time, and counts add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from newsgauge.functions.urls import canonical_url
from newsgauge.operators.funnel import noise_reason
from newsgauge.operators.report import merge_partials
from newsgauge.plans.search import parse_engine

LANDING_SCHEMA = (
    "engine string, keyword string, keyword_rank int, query_rank int, page_no int, body string, fetched_at timestamp"
)


def read_landing(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Landed payload files as a stream."""
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def parse_landing(payloads: DataFrame, engine: str, as_of) -> DataFrame:
    """Articles of one engine's usable payloads, by the parser and guard of the batch job."""
    return parse_engine(payloads, engine, as_of).drop("engine_rank")


def first_seen(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per keyword and canonical link; links are remembered for ``delay`` of fetch time."""
    keyed = articles.withColumn("url_key", canonical_url(F.col("url")))
    return keyed.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["keyword", "url_key"]).drop("url_key")


def count_increments(articles: DataFrame, partials: str, checkpoint: str) -> DataStreamWriter:
    """Write the counts of each micro-batch under ``partials``; a replayed batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reason = noise_reason(F.col("title"), F.coalesce("snippet", F.lit("")))
        tagged = batch.select("keyword", F.coalesce(reason, F.lit("kept")).alias("outcome"))
        counts = tagged.groupBy(F.col("keyword").alias("dimension"), F.col("outcome").alias("key")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{partials}/batch={batch_id}")

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_counts(spark: SparkSession, partials: str) -> DataFrame:
    return merge_partials(spark.read.parquet(partials).drop("batch"))
