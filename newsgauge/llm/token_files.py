"""Token ids in files: frequency ranks in one to four bytes, lengths apart in control bytes.

A file holds blocks of whole documents in ascending order of the document id. A block has two byte
columns. ``data`` has the frequency rank of each id in as few bytes as it needs, little-endian; the
commonest 256 ids need one. ``control`` has two bits for each id, four ids to a byte, the first id in
the lowest bits: its number of bytes less one. The ranks are a table beside the blocks. Parquet holds
the columns, so any store that Spark writes to will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.common import in_slices_of, query, shared_folder, staged, table, text_of
from newsgauge.llm.tokens import BYTE_BPE, text_encoder

#: Bytes of each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a block of ranks."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    control = four.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    keep = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of a block: lengths from the table of control bytes, then one gather per byte."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for byte in (1, 2, 3):
        long = np.flatnonzero(size > byte)
        if len(long) == 0:
            break
        out[long] |= raw[at[long] + byte].astype(np.uint32) << (8 * byte)
    return out


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, slice_bytes: int = 1 << 22) -> DataFrame:
    """doc_id and ids (with the end id) of every document, each row by itself; a worker holds texts of ``slice_bytes`` or one longer text."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_encoder(tokenizer)
        for part in in_slices_of(batches, "text", slice_bytes):
            bounds, ids = ids_of.many(part.column("text").to_pylist(), end_id)
            column = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds.tobytes()), ids])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column.cast(pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text", block_ids: int = 1 << 18) -> str:
    """Encode every document, append ``end_id`` to each, and write ids under ``path``.

    ``path/blocks`` has a folder for each range of document ids, in ascending order; a null id comes
    first. A block has at least ``block_ids`` ids, but for a range's last. ``path/ranks`` has the id of each rank; ids are ranked
    by their count over all documents, then by value. ``path/parts`` has the number of ids before each range. A null text is empty and has only the end id.
    Rows with one id are written one after another. An empty table gives files without rows. Other columns are ignored.

    Texts are encoded where they are read and written as ids, of two bytes with most vocabularies; these are counted, and shuffled
    once, by ranges. Only counts by id (as many as the vocabulary) and sums by range pass the driver.
    """
    documents = staged(encoded(docs, tokenizer, end_id, id_col, text_col), "token-ids", "zstd")
    dtype = text_encoder(tokenizer).dtype
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            here = np.bincount(_joined(batch.column("ids"), dtype))
            total, here = (here, total) if len(here) > len(total) else (total, here)
            total[: len(here)] += here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = documents.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.uint32)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")

    kind = documents.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one range: ``start`` counts the ids before in the range."""
        part, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, doc_ids = rows.column("ids").combine_chunks(), rows.column("doc_id").combine_chunks()
            lengths = pc.divide(pc.binary_length(ids), pa.scalar(dtype.itemsize, pa.int32()))
            control, data = pack_ranks(rank_of[_joined(ids, dtype)])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), one(doc_ids), one(lengths), pa.array([control], pa.binary()),
                 pa.array([data], pa.binary())], names=["part", "start", "doc_ids", "lengths", "control", "data"])

        for batch in in_slices_of(batches, "ids", block_ids * dtype.itemsize):
            held.append(batch)
            size += len(_joined(batch.column("ids"), dtype))
            if size >= block_ids:
                yield block()
                start, held, size = start + size, [], 0
        if held:
            yield block()

    ordered = documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(pack, f"part int, {_BLOCK.format(kind)}").write.partitionBy("part").parquet(f"{path}/blocks", compression="zstd")
    sums = _blocks(spark, path, kind).select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    parts, start = [], 0
    for part, n in sorted(map(tuple, sums.groupBy("part").agg(F.sum("n")).collect())):
        parts.append((part, start))
        start += n
    spark.createDataFrame(parts, "part int, before bigint").coalesce(1).write.parquet(f"{path}/parts")
    return path


_BLOCK = "start bigint, doc_ids array<{}>, lengths array<int>, control binary, data binary"


def _joined(ids: pa.Array, dtype: np.dtype) -> np.ndarray:
    """The ids of all rows of a binary column, one after another."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    raw = np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(ids) and ids.buffers()[2] is not None else np.empty(0, np.uint8)
    return raw.view(dtype)


def _blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_BLOCK.format(kind)}, part int").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before), n_tokens, ids (as little-endian unsigned 32-bit integers)."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # as many as the vocabulary
    by_rank = np.zeros(max(len(ranks), 1), "<u4")
    for r in ranks:
        by_rank[r["rank"]] = r["id"]
    before = {r["part"]: r["before"] for r in spark.read.parquet(f"{path}/parts").collect()}  # as many as the ranges
    try:
        kind = spark.read.parquet(f"{path}/blocks").schema["doc_ids"].dataType.elementType.simpleString()
    except Exception as error:  # a table without rows leaves a folder without files
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        kind = "bigint"
    blocks = _blocks(spark, path, kind).select("part", *[c.split()[0] for c in _BLOCK.split(", ")])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                doc_ids = block.column("doc_ids").flatten()
                lengths = block.column("lengths").flatten().to_numpy()
                control, data = (block.column(c)[0].as_py() for c in ("control", "data"))
                ids = by_rank[unpack_ranks(control, data, int(lengths.sum()))].tobytes()
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths + block.column("start")[0].as_py() + before[block.column("part")[0].as_py()]
                offsets = pa.array(np.concatenate([[0], ends * 4]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(starts), pa.array(lengths.astype(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets.buffers()[1], pa.py_buffer(ids)])],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(unpack, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
