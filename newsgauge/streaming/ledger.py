"""Coverage counts that can be withdrawn: signed increments, kept beside the facts they come from.

Increments that only add up go wrong when an article that came first by order lands late, or a payload is
landed again with other articles. A ledger keeps one narrow row an article in buckets by link, so that a batch of payloads
looks at the buckets of its own links and of the links it withdraws, and writes what changed there: minus what
the old rows counted, plus what the new ones count. The sum of all increments is the count of a batch job over the newest version
of every payload.

Folders under ``path``: ``facts/batch=/bucket=`` (a bucket is written anew by each batch that touches it), ``touched/batch=`` (those
buckets), ``payloads/batch=`` (versions seen and the buckets of their rows), ``deltas/batch=`` (the increments). A batch reads earlier
batches only and overwrites its own folders, so one that is replayed after a failure at any point gives the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from newsgauge import values as v
from newsgauge.operators.dedup import flag_first
from newsgauge.session import cut

FACTS = "payload string, version string, keyword string, url_key string, ord string, reason string, source string"
_COUNTS = "keyword string, dimension string, key string, n long"
_BUCKETS = 64


def count_facts(facts: DataFrame) -> DataFrame:
    """keyword, dimension (``outcome``, or ``source`` of kept rows), key, n.

    ``facts``: ``FACTS``, of which ``ord`` sorts articles. A row without a reason is kept if it is the first of its keyword and
    link, else a duplicate.
    """
    live = F.col("reason").isNull()
    # payload and ord tell rows apart: an article is one item of a payload
    rows = facts.withColumn("_row", F.concat_ws("\x00", F.col("ord"), F.col("payload")))
    rows = flag_first(rows, [F.col("keyword"), F.col("url_key")], [F.col("ord"), F.col("payload")], "_row", "_first", live)
    outcome = F.when(~live, F.col("reason")).when(F.col("_first"), "kept").otherwise(v.REASON_DUPLICATE)
    marks = F.array(F.struct(F.lit("outcome").alias("dimension"), outcome.alias("key")),
                    F.when(live & F.col("_first"), F.struct(F.lit("source").alias("dimension"), F.col("source").alias("key"))))
    marks = rows.select("keyword", F.explode(F.array_compact(marks)).alias("m")).select("keyword", "m.*")
    return marks.groupBy("keyword", "dimension", "key").agg(F.count("*").alias("n"))


def newest(facts: DataFrame) -> DataFrame:
    """The rows of the newest version of each payload."""
    last = facts.groupBy("payload").agg(F.max("version").alias("_last"))
    return facts.join(last, "payload").where(F.col("version") == F.col("_last")).drop("_last")


class Ledger:
    def __init__(self, spark: SparkSession, path: str, buckets: int = _BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, kind: str, schema: str, before: int) -> DataFrame:
        """What batches before ``before`` wrote."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        stored = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        return stored.where(F.col("batch") < before)

    def _write(self, df: DataFrame, kind: str, batch: int, by: list[str] | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{kind}/batch={batch}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("keyword", "url_key"), F.lit(self.buckets)).cast("int")

    def _stored(self, buckets: list[int], batch: int) -> DataFrame:
        """The rows of some buckets as the batches before left them."""
        last = self._read("touched", "bucket int", batch).where(F.col("bucket").isin(buckets)).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
        facts = self._read("facts", f"{FACTS}, bucket int", batch)
        at = [(F.col("bucket") == r["bucket"]) & (F.col("batch") == r["batch"]) for r in last]  # at most one a bucket
        return facts.where(reduce(Column.__or__, at, F.lit(False))).drop("batch")

    def apply(self, facts: DataFrame, batch: int) -> None:
        """Take in the articles of a batch of payloads (``FACTS``).

        Of several versions of a payload the newest counts: an older one, or one seen before, changes nothing.
        A payload version must come whole in one batch; one without articles, which withdraws all it had, is a row without a link.
        """
        incoming = cut(newest(facts.select(*[c.split()[0] for c in FACTS.split(", ")])))
        seen = self._read("payloads", "payload string, version string, buckets array<int>", batch)
        seen = cut(seen.join(incoming.select("payload").distinct(), "payload", "left_semi").groupBy("payload").agg(
            F.max_by(F.struct("version", "buckets"), "version").alias("_s")))
        fresh = incoming.join(seen.select("payload", F.col("_s.version").alias("_seen")), "payload", "left")
        fresh = cut(fresh.where(F.col("_seen").isNull() | (F.col("version") > F.col("_seen"))).drop("_seen").withColumn("bucket", self._bucket()))
        withdrawn = cut(seen.join(fresh.select("payload").distinct(), "payload", "left_semi").select("payload", F.explode_outer("_s.buckets").alias("bucket")))
        rows = fresh.where(F.col("url_key").isNotNull())
        buckets = [r[0] for r in rows.select("bucket").union(withdrawn.select("bucket")).distinct().collect() if r[0] is not None]  # at most ``buckets``

        old = self._stored(buckets, batch)
        new = cut(old.join(withdrawn.select("payload").distinct(), "payload", "left_anti").unionByName(rows.select(*old.columns)))
        signed = count_facts(new).unionByName(count_facts(old).withColumn("n", -F.col("n")))
        deltas = signed.groupBy("keyword", "dimension", "key").agg(F.sum("n").alias("n")).where("n <> 0")
        self._write(new, "facts", batch, ["bucket"])
        self._write(fresh.groupBy("payload", "version").agg(F.collect_set(F.when(F.col("url_key").isNotNull(), F.col("bucket"))).alias("buckets")), "payloads", batch)
        self._write(deltas, "deltas", batch)
        self._write(self.spark.createDataFrame([(b,) for b in buckets], "bucket int"), "touched", batch)

    def counts(self) -> DataFrame:
        """The sum of all increments."""
        deltas = self._read("deltas", _COUNTS, 1 << 62)
        return deltas.groupBy("keyword", "dimension", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def keep_ledger(facts: DataFrame, ledger: Ledger, checkpoint: str) -> DataStreamWriter:
    """Apply the micro-batches of a stream of facts; a replayed batch overwrites its own increments."""
    return facts.writeStream.foreachBatch(lambda batch, batch_id: ledger.apply(batch, batch_id)).option("checkpointLocation", checkpoint)
