"""Packing: documents go to tiers of context sizes, windows of each tier are filled to the last token."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.common import query, table, text_of
from newsgauge.llm.tokens import WORD_BPE, text_encoder

TIERS = (256, 512, 1024, 2048)

#: A piece of a document: (number of the document, first id in it, ids).
Piece = tuple[int, int, int]


class Packer:
    """Packs the pieces of a stream of documents.

    A document is cut at the longest window; what is left goes to the smallest tier that holds it.
    ``flush`` opens a window for each piece, from the longest tier to the shortest, and fills the gap
    with the largest waiting piece that fits, which comes from the same or a shorter tier. When none
    fits, the largest waiting piece is cut to fill the gap. So every window is full, and a piece is cut
    only where a gap is left. Pieces that cannot fill a window wait for the next documents. ``finish``
    puts the rest into windows of falling powers of two.

    Windows come out as (tier, pieces). The waiting pieces are those of at most ``waiting`` ids.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.lengths: list[int] = []  # of the waiting pieces, sorted
        self.pieces: dict[int, list[Piece]] = {}
        self.waiting = 0

    def _wait(self, piece: Piece) -> None:
        same = self.pieces.setdefault(piece[2], [])
        if not same:
            insort(self.lengths, piece[2])
        same.append(piece)
        self.waiting += piece[2]

    def _take(self, most: int) -> Piece:
        """The largest waiting piece of at most ``most`` ids, or else the head of the largest."""
        at = bisect_right(self.lengths, most) - 1
        cut = at < 0
        length = self.lengths[-1 if cut else at]
        same = self.pieces[length]
        piece = same.pop()
        self.waiting -= length
        if not same:
            del self.pieces[length], self.lengths[-1 if cut else at]
        if cut:
            doc, start, n = piece
            self._wait((doc, start + most, n - most))
            piece = (doc, start, most)
        return piece

    def _window(self, size: int) -> tuple[int, list[Piece]]:
        out, gap = [], size
        while gap:
            piece = self._take(gap)
            out.append(piece)
            gap -= piece[2]
        return size, out

    def add(self, doc: int, tokens: int) -> Iterator[tuple[int, list[Piece]]]:
        longest = self.tiers[-1]
        whole = tokens // longest * longest
        for start in range(0, whole, longest):
            yield longest, [(doc, start, longest)]
        if tokens > whole:
            self._wait((doc, whole, tokens - whole))

    def flush(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, each as long as the tier of the longest piece that waits."""
        while self.lengths:
            tier = next(t for t in self.tiers if t >= self.lengths[-1])
            while tier > self.waiting and tier > self.tiers[0]:
                tier //= 2
            if tier > self.waiting:
                return
            yield self._window(tier)

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        yield from self.flush()
        while self.waiting:
            yield self._window(1 << (self.waiting.bit_length() - 1))


class Steps:
    """Numbers windows into step groups: windows of one size, the same number of ids in each full group."""

    def __init__(self, first: int, step_tokens: int):
        self.next, self.step_tokens, self.open = first, step_tokens, {}

    def of(self, size: int) -> int:
        group, left = self.open.get(size, (0, 0))
        if left < size:
            group, left = self.next, max(self.step_tokens, size)
            self.next += 1
        self.open[size] = (group, left - size)
        return group


def pack_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
                   step_tokens: int = 1 << 16, hold_tokens: int = 1 << 21, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences whose lengths are powers of two, up to the longest tier.

    Each document is its ids and ``end_id``. One row for each piece: doc_id, start, length, ids (little-
    endian unsigned 32-bit integers), doc_tokens, sequence_id, offset, tier (the length of its sequence)
    and step_group (sequences of one tier that make a training step of ``step_tokens`` ids; the last
    group of a tier in a part may be smaller). The tiers are powers of two.

    Every part of the table is packed for itself as a stream, so nothing is shuffled, no key can be hot
    and a lost task is run again with the same result. Up to ``hold_tokens`` ids wait at once. All
    windows are full but for the last few of a part, which have falling powers of two down to one id;
    so there is no padding at all.

    A null or empty text has only the end id. Rows that repeat a document are packed each for itself. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_encoder(tokenizer)
        end = end_id.to_bytes(ids_of.width, "little")
        part = TaskContext.get().partitionId() << 32
        packer, steps, sequence = Packer(tiers), Steps(part, step_tokens), part
        texts: dict[int, list] = {}  # by number: doc_id, ids, ids not yet packed
        number, id_type, rows = 0, None, []

        def place(windows) -> None:
            nonlocal sequence
            for size, pieces in windows:
                step, offset = steps.of(size), 0
                for doc, start, length in pieces:
                    held = texts[doc]
                    rows.append((held[0], start, length, held[1][start * ids_of.width:(start + length) * ids_of.width],
                                 len(held[1]) // ids_of.width, sequence, offset, size, step))
                    offset += length
                    held[2] -= length
                    if not held[2]:
                        del texts[doc]
                sequence += 1

        def out() -> pa.RecordBatch:
            import numpy as np

            cols = [list(c) for c in zip(*rows)]
            cols[3] = [np.frombuffer(x, ids_of.dtype).astype("<u4").tobytes() for x in cols[3]]
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=NAMES)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = ids_of(text) + end
                n = len(ids) // ids_of.width
                texts[number] = [doc_id, ids, n]
                place(packer.add(number, n))
                number += 1
                if packer.waiting >= hold_tokens:
                    place(packer.flush())
                if len(rows) >= 2000:
                    yield out()
        place(packer.finish())
        while rows:
            yield out()

    return given.mapInArrow(pack, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                                  "sequence_id bigint, offset bigint, tier int, step_group bigint")


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "tier", "step_group")
