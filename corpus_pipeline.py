"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Each stage takes the documents that the stages before it kept and works on all of them. A stage's
result is written to the shared folder and read again, so a lost executor costs running tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.common import staged, table
from newsgauge.llm.exact_dedup import exact_dedup
from newsgauge.llm.near_dup import jaccard_join
from newsgauge.llm.packing import pack_documents
from newsgauge.llm.secret_scan import find_secrets
from newsgauge.llm.toxicity import fit_toxicity, score_toxicity

REJECTED_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below REJECTED_FROM, by a model fitted on labelled ones among them."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c != "doc_id"]
    return score_toxicity(docs, model, keep=others).where(F.col("score") < REJECTED_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts; of rows that repeat an id and a text, one."""
    others = [c for c in docs.columns if c != "doc_id"]
    kept = exact_dedup(docs, keep=others).where("kept").select(*docs.columns)
    repeats = docs.groupBy("doc_id").count().where("count > 1")
    return kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    others = staged(jaccard_join(docs).where("doc_id <> class_id").select("doc_id").distinct(), "near-copies")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by its kind; n_chars is the new length."""
    others = [c for c in docs.columns if c != "doc_id"]
    found = find_secrets(docs, mask=True, keep=others)
    text = F.when(F.col("text").isNotNull(), F.col("masked_text"))
    changed = {"text": text} | ({"n_chars": F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
                                if "n_chars" in others else {})
    return found.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    packed = pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", "step_group")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the string kernel nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
