"""Exact top-k by inner product: posting segments in descending impact, a stop on proof, exact rescoring."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsgauge.llm.common import in_groups, query, table


class ImpactIndex:
    """An index of one block of integer vectors.

    A segment holds the rows whose component in one dimension has one sign and one bit of its magnitude
    set; for a query its impact is the query's component times that bit. All bits of all components are
    in some segment, so all segments together give exact scores.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        self.planes = [int(m).bit_length() for m in size.max(axis=0)] if len(vectors) else []
        self.segments = {}
        for d, planes in enumerate(self.planes):
            negative = vectors[:, d] < 0
            for bit in range(planes):
                on = (size[:, d] >> bit) & 1 == 1
                self.segments[d, bit] = (np.flatnonzero(on & ~negative), np.flatnonzero(on & negative))

    def search(self, q: np.ndarray, k: int, own: np.ndarray, enough: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, and their exact scores; rows in ``own`` are left out.

        Segments are added in descending impact. What is left in a dimension is less than its last added
        bit, so the exact score of every row is within ``left`` of its sum so far. A row whose sum is
        more than twice that below the k-th best cannot be a member; the pass ends when at most
        ``enough`` others remain or nothing is left to add, and those are rescored from their vectors.
        """
        n = len(self.vectors)
        total = np.zeros(n, np.int64)
        total[own] = -(1 << 62)
        weight = np.abs(q)
        order = sorted(((int(weight[d]) << bit, d, bit) for d, bit in self.segments if weight[d]), reverse=True)
        left = sum(int(w) * ((1 << p) - 1) for w, p in zip(weight, self.planes))
        members, check = np.flatnonzero(total > -(1 << 61)), left // 2
        for impact, d, bit in order:
            plus, minus = self.segments[d, bit]
            if q[d] < 0:
                plus, minus = minus, plus
            total[plus] += impact
            total[minus] -= impact
            left -= impact
            if left <= check and len(members) > k:
                check = left * 3 // 4
                sums = total[members]
                kth = np.partition(sums, len(sums) - k)[len(sums) - k]
                members = members[sums >= kth - 2 * left]
                if len(members) <= enough:
                    break
        return members, self.vectors[members] @ q


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector",
          block_rows: int = 4096, block_queries: int = 1024) -> DataFrame:
    """The k vectors with the largest inner product for each query: query_id, rank, vec_id, score.

    Both tables have an id and an array of whole numbers. Ties go to the smaller id, all are returned if
    there are fewer than k, and vectors with the query's own id are left out, as are those of another
    length. Rows without an id or a vector, or with a null component, take no part; of several query
    rows with one id the smallest vector counts.

    Vectors and queries are dealt to blocks of bounded size by the hash of their ids. A task gets one
    block of each, builds the index and searches it; a query sends k rows from each block to the final
    ranking. What is copied is each vector once for every ``block_queries`` queries, and each query once
    for every ``block_rows`` vectors: the least that comparing all with all takes.
    """
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())

    def given(df: DataFrame) -> DataFrame:
        return df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("vector"))

    rows, asked = given(vectors), given(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-rows.count() // block_rows))
    n_asked = max(1, -(-asked.count() // block_queries))

    def block(of: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    pairs = (
        rows.withColumn("block", block(F.col("id"), n_blocks)).withColumn("part", all_of(n_asked)).withColumn("asks", F.lit(False))
        .unionByName(asked.withColumn("part", block(F.col("id"), n_asked)).withColumn("block", all_of(n_blocks)).withColumn("asks", F.lit(True)))
        .withColumn("size", F.size("vector"))
        .repartition("block", "part").sortWithinPartitions("block", "part", "size")
    )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["block", "part", "size"]):
            asks = group.column("asks").to_numpy()
            ids = group.column("id").to_numpy()
            flat = group.column("vector").combine_chunks().flatten().to_numpy()
            matrix = flat.reshape(len(ids), group.column("size")[0].as_py())
            found, own_ids = ids[~asks], ids[asks]
            if len(found) == 0 or len(own_ids) == 0:
                continue
            index, out = ImpactIndex(matrix[~asks]), []
            for query_id, q in zip(own_ids, matrix[asks]):
                members, scores = index.search(q, k, np.flatnonzero(found == query_id))
                best = np.lexsort((found[members], -scores))[:k]
                out.append((np.full(len(best), query_id), found[members][best], scores[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op7_impact_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vector FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.vector, v.vector) AS BIGINT) AS score
           FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op7_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = (table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & finite)
               .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector")))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
