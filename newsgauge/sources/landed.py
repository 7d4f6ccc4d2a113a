"""The landed article table.

Articles are stored by ``source`` and ``day``. Rows without a proper day go to the NULL day, so the rule
that keeps them does not stop a date range from pruning folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.functions.dates import ISO_DAY


def write_articles(df: DataFrame, path: str) -> None:
    """Store articles. A day's rows come together, and adaptive execution splits days that are too large for a task."""
    day = F.when(F.col("date").rlike(ISO_DAY), F.col("date").try_cast("date"))
    rows = df.withColumn("day", day).hint("rebalance", "source", "day")
    rows.write.partitionBy("source", "day").parquet(path)


def read_articles(spark: SparkSession, path: str, date_from: str, date_to: str, mode: str = "all") -> DataFrame:
    """Articles of a day range (and those without a day), of one source or all; reads only their folders."""
    df = spark.read.parquet(path)
    if mode != "all":
        df = df.where(F.col("source") == mode)
    wanted = F.col("day").isNull() | F.col("day").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    return df.where(wanted).drop("day")
