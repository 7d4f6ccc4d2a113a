"""Exact duplicates: group by a 128-bit content hash, compare the bytes inside groups, keep one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgauge.llm.common import carried, given_back, query, staged, table, text_of

SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")


def without_spaces(text: Column) -> Column:
    """The text without the six ASCII white-space characters; byte searches, no regular expression."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                content_hash: Callable[[Column], Column] = F.md5, keep: Sequence[str] = ()) -> DataFrame:
    """Which row of each set of equal texts stays.

    Texts are equal when their bytes are equal once ASCII white space is removed. Of equal texts the
    row with the most code points in the original text stays, then the smallest id (a null id is the
    largest). Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and
    the columns ``keep`` of ``docs``.

    The grouping key is a 128-bit hash of the text. The bytes of a group are compared through its
    smallest and largest text, which are equal unless the hash collides; the rows of a colliding hash
    are grouped by the text itself. Groups are aggregated before the shuffle, so a text that a third of
    all rows carry sends one row per task; the rows of a hot text meet their group in a join of narrow
    rows (but for ``keep``), whose large partitions adaptive execution splits. The colliding hashes are
    written for themselves, so that Spark knows how few they are before it joins the texts with them.

    A null text counts as empty, and all empty texts are one group. Rows that repeat an id and a text
    are one document: if it stays, all its rows are marked. An empty table gives an empty result. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    text = text_of(text_col)
    full = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("_chars"),
                       without_spaces(text).alias("_norm"), *carried(keep))
    full = full.withColumn("_hash", content_hash(F.col("_norm")))
    narrow = full.withColumn("text_sha256", F.sha2("_norm", 256)).drop("_norm", "_chars")

    best = F.min(F.struct((-F.col("_chars")).alias("chars"), F.col("doc_id").isNull().alias("none"),
                          F.col("doc_id").alias("id")))

    def groups(df: DataFrame, *by: str) -> DataFrame:
        out = df.groupBy(*by).agg(best.alias("_best"), F.count("*").alias("group_size"),
                                  F.min("_norm").alias("_low"), F.max("_norm").alias("_high"))
        return out.select(*by, F.col("_best.id").alias("keep_id"), "group_size", (F.col("_low") != F.col("_high")).alias("_collides"))

    classes = staged(groups(full, "_hash"), "exact-classes")
    colliding = staged(classes.where("_collides").select("_hash"), "colliding-hashes")

    plain = narrow.join(classes.where("not _collides"), "_hash")
    odd = full.join(colliding, "_hash", "left_semi").withColumn("text_sha256", F.sha2("_norm", 256))
    odd = odd.join(groups(odd, "_hash", "_norm"), ["_hash", "_norm"])

    def result(df: DataFrame) -> DataFrame:
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return df.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *given_back(keep))

    return result(plain).unionByName(result(odd))


@query("op6_exact_dedup", """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
     w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM w
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
