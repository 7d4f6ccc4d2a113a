"""Connected components by alternating stars: no group is gathered, nothing passes the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgauge.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (a, b: whole numbers).

    Each round hangs the larger neighbours of every node on its smallest one, then the node and its
    smaller neighbours; depths fall fast, so a few rounds do. A round is written to the shared folder.
    Smallest neighbours are partial aggregates; the join back is split by adaptive execution where one
    node has very many neighbours.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = staged(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
