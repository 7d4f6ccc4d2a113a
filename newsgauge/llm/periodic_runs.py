"""Periodic runs of words: a run-length grammar by recompression, whose LCE queries extend candidates on harmonic grids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newsgauge.llm.common import carried, given_back, in_slices_of, query, table, text_of

LEAST_WORDS = 12  # a run has at least so many words, and at least two periods
QUERIES_AT_ONCE = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Level:
    """One string of the grammar, and the next one's phrases in it: block (a symbol repeated) or pair."""

    symbols: np.ndarray
    up: np.ndarray     # for each symbol the phrase it is in
    first: np.ndarray  # for each phrase its first and last symbol
    last: np.ndarray
    block: bool


class Grammar:
    """A run-length grammar of a string of whole numbers, made by recompression.

    Block compression names each maximal repetition of one symbol, pair compression names neighbours
    whose left one is of one half of the alphabet and whose right one is of the other; they alternate
    until no symbol occurs twice. Equal phrases of a level have equal names, and where a phrase starts
    depends on its neighbours only, so equal substrings are parsed alike but for their ends.

    The first and the last symbol must occur once each: they end every extension.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        self.names = int(symbols.max()) + 1 if len(symbols) else 0
        symbols = symbols.astype(np.int64)
        while len(np.unique(symbols)) < len(symbols):
            symbols = self._blocks(symbols)
            if len(np.unique(symbols)) < len(symbols):
                symbols = self._pairs(symbols)
        self.top = symbols

    def _phrases(self, symbols: np.ndarray, starts: np.ndarray, names: np.ndarray, block: bool) -> np.ndarray:
        opens = np.zeros(len(symbols), np.int32)
        opens[starts] = 1
        last = np.append(starts[1:], len(symbols)) - 1
        self.levels.append(Level(symbols, np.cumsum(opens, dtype=np.int32) - 1, starts.astype(np.int32), last.astype(np.int32), block))
        return names

    def _named(self, codes: np.ndarray) -> np.ndarray:
        distinct, names = np.unique(codes, return_inverse=True)
        names = names + self.names
        self.names += len(distinct)
        return names

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(starts) == len(symbols):
            return symbols
        count = np.diff(np.append(starts, len(symbols)))
        names = symbols[starts]
        long = np.flatnonzero(count > 1)
        names[long] = self._named(names[long] * (len(symbols) + 1) + count[long])
        return self._phrases(symbols, starts, names, True)

    def _pairs(self, symbols: np.ndarray) -> np.ndarray:
        """Neighbours differ here. The halves are those, of a few hashed ones, with the most pairs; should
        they have none, some bit of the names tells the first two symbols apart."""

        def halves() -> Iterator[np.ndarray]:
            for m in _MULTIPLIERS:
                yield ((symbols.astype(np.uint64) * np.uint64(m)) >> np.uint64(63)).astype(bool)

        best, most = None, 0
        for side in halves():
            for left in (side, ~side):
                at = left[:-1] & ~left[1:]
                n = int(np.count_nonzero(at))
                if n > most:
                    best, most = at, n
        bit = 0
        while best is None:
            left = (symbols >> bit) & 1 == (int(symbols[0]) >> bit) & 1
            at = left[:-1] & ~left[1:]
            best, bit = (at if at.any() else None), bit + 1
        pairs = np.flatnonzero(best)
        opens = np.ones(len(symbols), bool)
        opens[pairs + 1] = False
        starts = np.flatnonzero(opens)
        names = symbols.copy()
        names[pairs] = self._named(symbols[pairs] * self.names + symbols[pairs + 1])
        return self._phrases(symbols, starts, names[starts], False)

    def extend(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from x and y on are equal, forward (step 1) or backward (step -1); x and y differ.

        Up the levels both places move past what is left of their phrases, which are equal if the extension
        goes on, until symbols differ; then down, where at most one step a level is left to match. That is
        a number of steps in the order of the levels, not of the length that matches.
        """
        each, a, b = np.arange(len(x)), x.astype(np.int32), y.astype(np.int32)
        halted: list[tuple[np.ndarray, ...]] = []
        for lv in self.levels:
            p, q = lv.up[a], lv.up[b]
            edge, far = (lv.first, lv.last) if step > 0 else (lv.last, lv.first)
            same = lv.symbols[a] == lv.symbols[b]
            inside = same & ((a != edge[p]) | (b != edge[q]))
            left, right = np.abs(far[p] - a), np.abs(far[q] - b)
            move = np.where(inside, np.minimum(left, right) + 1, 0).astype(np.int32) * step
            a, b = a + move, b + move
            stop = ~same | (inside & (left != right))
            halted.append((each[stop], a[stop], b[stop]))
            go = ~stop
            each, a, b = each[go], lv.up[a[go]], lv.up[b[go]]
        for lv, (more, ma, mb) in zip(reversed(self.levels), reversed(halted)):
            edge = lv.first if step > 0 else lv.last
            size = lv.last - lv.first + 1
            move = np.minimum(size[a], size[b]) if lv.block else 1
            a, b = edge[a], edge[b]
            move = np.where(lv.symbols[a] == lv.symbols[b], move, 0).astype(np.int32) * step
            each = np.concatenate([each, more])
            a, b = np.concatenate([a + move, ma]), np.concatenate([b + move, mb])
        out = np.empty(len(x), np.int64)
        out[each] = np.abs(a - x[each])
        return out


def _near(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether three more words after, or the three words before, two equal ones are equal too. An
    extension of six words or more, which every run needs, has one or the other."""
    after = before = True
    last = len(s) - 1
    for i in (1, 2, 3):
        after = after & (s[np.minimum(a + i, last)] == s[np.minimum(b + i, last)])
        before = before & (s[np.maximum(a - i, 0)] == s[np.maximum(b - i, 0)])
    return after | before


def _candidates(s: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a and periods p with equal words at a and a + p, for all a on the grid of multiples of p.

    A run of two periods covers two neighbours on its grid. ``ends`` are those of the documents in ``s``,
    longest first, so each grid reaches only as far as documents are long enough for its period.
    """
    if not len(lengths) or lengths[0] < least:
        return
    periods = np.arange(1, lengths[0] // 2 + 1)
    reach = np.searchsorted(-lengths, -np.maximum(2 * periods, least), side="right")
    held, periods_of, n = [], [], 0
    for p, docs in zip(periods.tolist(), reach.tolist()):
        part = s[: ends[docs - 1]]
        at = np.flatnonzero(part[: len(part) - p : p] == part[p::p]) * p
        if len(at):
            at = at[_near(s, at, at + p)]
            held.append(at)
            periods_of.append(np.full(len(at), p))
            n += len(at)
        if n >= QUERIES_AT_ONCE:
            yield np.concatenate(held), np.concatenate(periods_of)
            held, periods_of, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(periods_of)


def runs_of(documents: Sequence[np.ndarray], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """The runs of each document, given as numbers of its words: rows (start, length, period) by start, then period.

    A run is a stretch with smallest period p and at least max(least, 2 p) words that no neighbouring word
    extends. ``least`` is 12 or more. The documents with a candidate share one grammar.
    """
    if least < 12:
        raise ValueError("runs of fewer than 12 words need a wider test of neighbours")
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    order = [i for i in order if len(documents[i]) >= least]
    out = [np.empty((0, 3), np.int64)] * len(documents)

    def joined(which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents with a symbol of its own before, between and after them; their starts and ends."""
        lengths = np.array([len(documents[i]) for i in which])
        starts = np.cumsum(lengths + 1) - lengths
        top = max(int(documents[i].max()) for i in which) + 1
        s = np.empty(int(lengths.sum()) + len(which) + 1, np.int64)
        s[0], s[starts + lengths] = top, top + 1 + np.arange(len(which))
        for i, at in zip(which, starts):
            s[at : at + len(documents[i])] = documents[i]
        return s, starts, starts + lengths

    if not order:
        return out
    s, starts, ends = joined(order)
    lengths = ends - starts
    hit = np.zeros(len(order), bool)
    for at, _ in _candidates(s, ends, lengths, least):
        hit[np.searchsorted(starts, at, side="right") - 1] = True
    order = [i for i, h in zip(order, hit) if h]
    if not order:
        return out
    s, starts, ends = joined(order)
    grammar = Grammar(s)
    found = np.empty((0, 3), np.int64)
    for at, period in _candidates(s, ends, ends - starts, least):
        begin = at - grammar.extend(at - 1, at + period - 1, -1)
        end = at + period + grammar.extend(at, at + period, 1)
        run = end - begin >= np.maximum(least, 2 * period)
        found = np.concatenate([found, np.stack([begin[run], end[run], period[run]], 1)])
        # a multiple of a period covers the same words: the smallest stays
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))] if len(found) else found
    doc = np.searchsorted(starts, found[:, 0], side="right") - 1
    rows = np.stack([found[:, 0] - starts[doc], found[:, 1] - found[:, 0], found[:, 2]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], doc))]
    cuts = np.searchsorted(np.sort(doc), np.arange(len(order) + 1))
    for k, i in enumerate(order):
        out[i] = rows[cuts[k] : cuts[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, slice_bytes: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text",
              keep: Sequence[str] = ()) -> DataFrame:
    """Periodic runs of each text's words: doc_id, n_words, runs (start, length, period), collapsed_text, and ``keep``.

    Words are what ASCII white space parts, compared as bytes. ``runs`` lists every run by start, then
    period; ``collapsed_text`` has the words that no run contains after its first period, joined by
    one space. Each row is worked on by itself, so nothing is shuffled, and copies or a hot source make no
    task larger than its rows. A worker holds texts of ``slice_bytes`` (or one longer text) and about
    100 bytes a word for the grammar; a text of n words costs n log n steps, whatever repeats in it.

    A null or blank text has no words, no runs and an empty collapsed text; rows with equal or null ids
    stay as they are. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    schema = StructType([
        StructField("doc_id", docs.schema[id_col].dataType), StructField("n_words", LongType()),
        *StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>").fields,
        StructField("collapsed_text", StringType()),
        *[StructField(f"_keep{i}", docs.schema[c].dataType) for i, c in enumerate(keep)],
    ])
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices_of(batches, "_text", slice_bytes):
            words = [t.split() for t in part.column("_text").to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(sizes)
            numbers = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            runs = runs_of([numbers[e - n : e] for e, n in zip(ends, sizes)], least)
            texts = []
            for ws, found in zip(words, runs):
                if len(found):
                    stays = kept_words(len(ws), found)
                    ws = [w for w, k in zip(ws, stays.tolist()) if k]
                texts.append(b" ".join(ws))
            flat = np.concatenate(runs)
            cuts = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type)))
            columns = [part.column("doc_id"), pa.array(sizes), lists, pa.array(texts, pa.binary()).view(pa.string()),
                       *[part.column(f"_keep{i}") for i in range(len(keep))]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("_text"), *carried(keep))
    return rows.mapInArrow(work, schema).select("doc_id", "n_words", "runs", "collapsed_text", *given_back(keep))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the texts repeat a stretch of their words to the end.

    h is the crc32 of the decimal id. Where it ends in 0, g is its other digits, n the number of words, a = g % n
    and p = 1 + floor((n - a) / (3 + g % 8)): the words from a on are p words, over and over.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text_of("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", text_of("text").alias("text"), (h % 10 == 0).alias("_chosen"), F.floor(h / 10).alias("_g"))
    # in an array of one, the words of the few chosen texts are split once
    one = F.array(F.when(F.col("_chosen"), words))

    def planted(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.col("_g") % n
        p = F.lit(1) + F.floor((n - a) / (3 + F.col("_g") % 8))
        over = F.flatten(F.array_repeat(F.slice(ws, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a.cast("int")), F.slice(over, F.lit(1), (n - a).cast("int"))), " ")

    text = F.element_at(F.transform(one, lambda ws: F.when(F.size(ws) > 0, planted(ws))), 1)
    return chosen.select("doc_id", F.coalesce(F.when(F.col("_chosen"), text), F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row of numbers and hashes for each document's runs."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("_best.n")
    return out.select("doc_id", "n_runs", F.col("_best.start").alias("start"), length.alias("length"), F.col("_best.period").alias("period"),
                      F.floor(1000 * length / F.col("_best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(with_planted_periods(table(spark, sf_dir, "documents"))))
