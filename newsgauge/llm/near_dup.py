"""N-gram Jaccard join: minimum hashes compared step by step with Bayesian pruning, the rest verified exactly."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from math import ceil, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.common import in_groups, query, staged, table, text_of
from newsgauge.llm.components import components

BANDS, ROWS, STEP = 32, 4, 16
HASHES = BANDS * ROWS
_U = np.uint64
_RANDOM = np.random.default_rng(20_24)
_FACTOR = _RANDOM.integers(0, 1 << 63, HASHES, dtype=_U) << _U(1) | _U(1)
_ADD = _RANDOM.integers(0, 1 << 63, HASHES, dtype=_U)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=_U) << _U(1) | _U(1)
#: First and last characters of scripts written without spaces, of which each character is a word (fixed values).
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
          (0x20000, 0x3FFFF))
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, _U), np.ones(1, _U))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _kinds(size: int) -> np.ndarray:
    """Of each of the first ``size`` characters: 0 between words, 1 in a word, 2 a word by itself."""
    kinds = np.array([unicodedata.category(chr(c))[0] in "LMN" or c == 95 for c in range(size)], np.uint8)
    for first, last in SINGLE:
        kinds[first:last + 1] *= 2
    return kinds


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of a text as numbers, and where its words start and end."""
    wide = not text.isascii()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if wide else np.frombuffer(text.encode(), np.uint8)
    kinds = _kinds(128 if not wide else 0x3000 if raw.max() < 0x3000 else 0x110000)[raw]
    inside = np.concatenate([[0], kinds, [0]])
    alone = inside == 2
    starts = np.flatnonzero((inside[1:] > 0) & ((inside[:-1] == 0) | alone[1:] | alone[:-1]))
    ends = np.flatnonzero((inside[:-1] > 0) & ((inside[1:] == 0) | alone[1:] | alone[:-1]))
    return raw, starts, ends


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        base = np.full(2 * n, _BASE, _U)
        inverse = np.full(2 * n, pow(_BASE, -1, 1 << 64), _U)
        base[0] = inverse[0] = 1
        _powers = np.cumprod(base), np.cumprod(inverse)
    return _powers


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of the runs of ``words`` words of the lower-cased text.

    A word is a run of letters, marks, digits and underscores of any script; in scripts without spaces each
    character is one. Quotes, dashes and spaces beyond ASCII part words like others. A text with fewer words
    has one shingle, of all its words; one without words has none.
    """
    raw, starts, ends = word_bounds(text.lower())
    if len(starts) == 0:
        return np.zeros(0, _U)
    powers, inverses = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * powers[: len(raw)], out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * inverses[starts])
    n = min(words, len(hashes))
    count = len(hashes) - n + 1
    total = np.full(count, n, _U)
    for i in range(n):
        total += hashes[i:i + count] * _PLACE[i % 64]
    return np.unique(_mix(total))


def minimum_hashes(values: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, (1 << 32) - 1, np.uint32)
    for at in range(0, len(values), 4096):
        part = values[at:at + 4096] * _FACTOR[:, None] + _ADD[:, None]
        np.minimum(out, (part >> _U(32)).min(axis=1).astype(np.uint32), out=out)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, how many of the hashes compared so far must match for a pair to go on.

    With a uniform prior on the similarity s, and bytes of hashes compared, so that an unequal pair
    matches by chance once in 256: the least number m for which P(s >= threshold | m) is at least the tolerance.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p) + lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return out


def similar(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of ``others`` stay after the incremental comparison with ``one`` (or with as many rows)."""
    alive = np.arange(len(others))
    matches = np.zeros(len(others), int)
    paired = one.ndim == 2
    for step, need in enumerate(least):
        cut = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (others[alive, cut] == (one[alive, cut] if paired else one[cut])).sum(axis=1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
        if len(alive) == 0:
            break
    return alive


class Forest:
    """Sets of rows joined so far; the root of a set is its first row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.root[rows])
        self.root[np.isin(self.root, roots[1:])] = roots[0]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes."""
    _, offsets, data = column.buffers()
    if data is None or len(column) == 0:
        return np.zeros((0, width), np.uint8)
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[at:at + len(column) * width].reshape(-1, width)


def _profiles(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, sketches, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text, words)
                sizes.append(len(values))
                if len(values) == 0:
                    same.append(None), sketches.append(None), keys.append(None)
                    continue
                low = minimum_hashes(values)
                same.append(xxhash.xxh3_128_digest(values.tobytes()))
                sketches.append((low & 0xFF).astype(np.uint8).tobytes())
                bands = low.reshape(BANDS, ROWS).astype(_U) * _PLACE[:ROWS]
                keys.append(_mix(bands.sum(axis=1) + _PLACE[8] * np.arange(BANDS, dtype=_U)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "size", "sketch", "keys"])

    return given.mapInArrow(profile, "doc_id bigint, same binary, size int, sketch binary, keys array<bigint>")


def _cells(block, n):
    """The pairs of blocks that a row of ``block`` takes part in, of ``n`` blocks."""
    return F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"))))


def _candidate_edges(nodes: DataFrame, least: list[int], bucket_rows: int) -> DataFrame:
    """Edges (a, b) that join all nodes which a chain of surviving pairs connects.

    Nodes meet in the buckets of their bands. Buckets of one node are dropped by a count; a bucket of
    more than ``bucket_rows`` nodes is compared in pairs of blocks. Within a task, nodes that are
    connected already need no comparison, so a group of n near copies costs about n comparisons and
    sends at most n - 1 edges on.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / bucket_rows).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("cell", _cells(F.col("block"), F.col("blocks")))
    met = (met.select("node", "key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))
           .join(nodes.select("node", "sketch"), "node")
           .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def edges(parts, last: bool):
            cell, node, sketch = parts
            change = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(node)]])
            kept = None
            if not last:
                kept = tuple(x[starts[-1]:] for x in parts)
                starts, ends = starts[:-1], ends[:-1]
            out = []
            pairs = starts[ends - starts == 2]
            alive = pairs[similar(sketch[pairs], sketch[pairs + 1], least)]
            out.append(np.column_stack([node[alive], node[alive + 1]]))
            for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                forest = Forest(end - start)
                for i in range(end - start - 1):
                    rest = i + 1 + np.flatnonzero(forest.root[i + 1:] != forest.root[i])
                    if len(rest):
                        hit = rest[similar(sketch[start + i], sketch[start + rest], least)]
                        if len(hit):
                            forest.join(np.append(hit, i))
                own = np.flatnonzero(forest.root != np.arange(end - start))
                out.append(np.column_stack([node[start + own], node[start + forest.root[own]]]))
            return np.unique(np.concatenate(out), axis=0), kept

        def batch_of(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = (np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")]),
                     batch.column("node").to_numpy(), _matrix(batch.column("sketch"), HASHES))
            if held is not None:
                parts = tuple(np.concatenate(x) for x in zip(held, parts))
            found, held = edges(parts, False)
            yield batch_of(found)
        if held is not None:
            yield batch_of(edges(held, True)[0])

    return met.mapInArrow(compare, "a bigint, b bigint").distinct()


def _intersections(sets: list[np.ndarray], rows: slice) -> np.ndarray:
    """How many shingles each set of ``rows`` shares with every set.

    Shingles of many sets are multiplied as a 0/1 matrix, the others are counted through their lists.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(ids)
    out = np.zeros((len(sets[rows]), len(sets)), np.int64)
    often = np.flatnonzero(count > 64)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    for at in range(0, len(often), 2048):
        here = (place[ids] >= at) & (place[ids] < at + 2048)
        matrix = np.zeros((len(sets), min(2048, len(often) - at)), np.float32)
        matrix[owner[here], place[ids[here]] - at] = 1
        out += (matrix[rows] @ matrix.T).astype(np.int64)
    rare = (count[ids] > 1) & (count[ids] <= 64)
    order = np.argsort(ids[rare], kind="stable")
    values, holders = ids[rare][order], owner[rare][order]
    for gap in range(1, 64):  # neighbours at each distance in the list of one shingle
        same = np.flatnonzero(values[gap:] == values[:-gap])
        if len(same) == 0:
            break
        for a, b in ((holders[same], holders[same + gap]), (holders[same + gap], holders[same])):
            mine = (a >= rows.start) & (a < rows.stop)
            np.add.at(out, (a[mine] - rows.start, b[mine]), 1)
    return out


def _verify(members: DataFrame, threshold: float, words: int) -> DataFrame:
    """Exact links within candidate groups: node, root, links (documents linked to, without own copies), more.

    One row for each node and pair of blocks; ``more`` says that the group has several pairs of blocks,
    so the roots are to be joined. Pairs are counted where they are found, never sent on.
    """
    members = members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["comp", "i", "j"]):
            node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
            order = np.argsort(node)
            node, copies, block = node[order], copies[order], block[order]
            texts = group.column("text").to_pylist()
            sets = [shingles(texts[k], words) for k in order]
            sizes = np.array([len(s) for s in sets])
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            links, forest = np.zeros(len(node), np.int64), Forest(len(node))
            tile = max(1, (1 << 22) // len(node))
            for at in range(0, len(node), tile):
                rows = slice(at, min(at + tile, len(node)))
                both = _intersections(sets, rows)
                either = sizes[rows, None] + sizes - both
                hit = both >= np.ceil(threshold * either - 1e-9)
                hit[np.arange(rows.stop - at), np.arange(at, rows.stop)] = False
                if across:
                    hit &= block[rows, None] != block
                links[rows] = hit @ copies
                for k in np.flatnonzero(hit.any(axis=1)):
                    other = np.flatnonzero(hit[k])
                    if (forest.root[other] != forest.root[at + k]).any():
                        forest.join(np.append(other, at + k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(node[forest.root]), pa.array(links), group.column("more").combine_chunks()],
                names=["node", "root", "links", "more"])

    return members.mapInArrow(verify, "node bigint, root bigint, links bigint, more boolean")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-6, bucket_rows: int = 4096,
                 block_shingles: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near duplicates: every document with its group and how many others it is linked to.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is at least
    ``threshold``. Returns doc_id, class_id (the smallest doc_id of the connected group), copy_id (the
    smallest doc_id with the same set of shingles) and n_links, one row per row of ``docs``.

    Documents with equal sets are one node. Nodes become candidates when one of 32 bands of four minimum
    hashes is equal: a pair at 0.8 is missed with probability below 1e-7. Candidates compare 128 hashes
    in steps of 16 and stop as soon as the probability of reaching the threshold falls below
    ``tolerance``. Survivors only decide which documents come together; within those groups all links
    are found exactly, from the texts.

    Nothing is sent on for each pair: tasks send counts and spanning edges. Hot buckets and large groups
    are compared in pairs of blocks of bounded size (``bucket_rows`` nodes, ``block_shingles`` shingles).

    A document without words, null or empty, is linked to none and is its own group, as is a row without
    an id (whose ids here are null). Rows that repeat an id and a text are copies of each other; an id stands for
    one text. An empty
    table gives no rows. Other columns are ignored, whatever their names. Ids are whole numbers.
    """
    profiles = staged(_profiles(docs, words, id_col, text_col), "profiles")
    linked = profiles.where("doc_id is not null and size > 0")
    nodes = staged(linked.groupBy("same").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("size").alias("size"),
                                              F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "nodes")

    groups = components(_candidate_edges(nodes, least_matches(threshold, tolerance), bucket_rows))
    found = groups.join(nodes.select("node", "copies", "size"), "node").withColumnRenamed("root", "comp")
    weights = found.groupBy("comp").agg(F.sum("size").alias("total"))
    found = found.join(weights, "comp").withColumn("blocks", F.ceil(F.col("total") / block_shingles).cast("int"))
    found = found.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("total", "size")
    found = staged(found, "candidates")

    texts = docs.select(F.col(id_col).cast("long").alias("node"), text_of(text_col).alias("text"))
    members = found.join(texts, "node").dropDuplicates(["node"]) if _repeats_ids(profiles) else found.join(texts, "node")
    members = members.withColumn("cell", _cells(F.col("block"), F.col("blocks")))
    members = members.select("node", "comp", "copies", "block", "text", (F.col("blocks") > 1).alias("more"),
                             F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))
    exact = staged(_verify(members, threshold, words), "links")

    roots = exact.where("not more").select("node", "root")
    several = exact.where("more and node <> root")
    if not several.isEmpty():
        roots = roots.unionByName(components(several.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    counts = exact.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.select("same", "node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    of_node = of_node.select("same", "node", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    out = linked.select("doc_id", "same").join(of_node, "same").select(
        "doc_id", F.coalesce("root", "node").alias("class_id"), F.col("node").alias("copy_id"), "n_links")
    alone = profiles.where("doc_id is null or size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def _repeats_ids(profiles: DataFrame) -> bool:
    return not profiles.groupBy("doc_id").count().where("count > 1").isEmpty()


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
