"""Toxicity: a subsequence string kernel with Nyström landmarks, a support vector machine, stems, calibrated scores."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.common import carried, given_back, in_slices, query, staged, table, text_of

LONGEST, OVERLAP, SPAN, DECAY = 20, 10, 7, 0.6
SHORTEST_STEM, LONGEST_STEM = 4, 9
#: How many standard deviations beyond chance a stem's toxic sentences are; and the least log-odds it adds.
SURE, LEAST_ODDS = 6.0, 1.0
#: What a word of a text costs against the log-odds of its stems; calibration takes the best.
COSTS = (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04)
_SENTENCE = re.compile(r"[.!?]+\s|\n")
_DIGITS = dict(zip("013457", "oieast"))


def _letters() -> np.ndarray:
    """Letter 0-25 of each Latin-1 byte: accents are dropped, digits that stand for letters read as those; 26 is other, 27 is space."""
    out = np.full(256, 26, np.uint8)
    for b in range(256):
        c = unicodedata.normalize("NFD", _DIGITS.get(chr(b), chr(b)).lower())[0]
        out[b] = ord(c) - 97 if "a" <= c <= "z" else 27 if chr(b).isspace() else 26
    return out


_LETTER = _letters()


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the three-letter subsequences of a word within the span, and their weights.

    A subsequence weighs DECAY for each letter it passes over; weights are scaled by the length, as if
    all subsequences differed, so that words of any length compare.
    """
    at = np.array([(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, length)
                   if k - i < SPAN]).reshape(-1, 3)
    weight = DECAY ** (at[:, 2] - at[:, 0] - 2.0) if len(at) else np.zeros(0)
    return at[:, 0], at[:, 1], at[:, 2], (weight / max(np.sqrt((weight**2).sum()), 1e-9)).astype(np.float32)


@dataclass
class Words:
    """The words of several texts: all letters in one array, and start, length and text of each word."""

    letters: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        for n in np.unique(self.length):
            if n >= 3:
                yield int(n), np.flatnonzero(self.length == n)

    def codes(self, length: int, rows: np.ndarray) -> np.ndarray:
        i, j, k, _ = _triples(length)
        w = self.letters[self.start[rows, None] + np.arange(length)].astype(np.int32)
        return (w[:, i] * 26 + w[:, j]) * 26 + w[:, k]


def words_of(texts: list[str]) -> Words:
    """Runs of letters; one inserted sign within a word is passed over, and letters spaced out one by one are one word.

    A run longer than LONGEST letters gives overlapping windows, so that all of it is read.
    """
    lowered = [t.lower() for t in texts]
    raw = np.frombuffer("\n\n\n".join(lowered).encode("latin-1", "replace"), np.uint8)
    code = _LETTER[raw]
    at = np.flatnonzero(code < 26)
    if len(at) == 0:
        return Words(np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(3)))
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    starts = np.concatenate([[0], breaks])
    sizes = np.diff(np.concatenate([starts, [len(at)]]))
    near = at[breaks] - at[breaks - 1] == 2
    spaced = code[at[breaks] - 1] == 27
    single = (sizes[1:] == 1) & (sizes[:-1] == 1)
    word = starts[np.concatenate([[True], ~(near & (~spaced | single))])]
    length = np.diff(np.concatenate([word, [len(at)]]))
    step = LONGEST - OVERLAP
    parts = np.maximum(1, -(-(length - OVERLAP) // step))
    which = np.repeat(np.arange(len(word)), parts)
    shift = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * step
    start, length = word[which] + shift, np.minimum(length[which] - shift, LONGEST)
    begin = np.cumsum([0] + [len(t) + 3 for t in lowered[:-1]])
    return Words(code[at], start, length, np.searchsorted(begin, at[start], side="right") - 1)


def word_set(text: str) -> set[str]:
    """The distinct words of a text as the kernel reads them."""
    w = words_of([text])
    spelled = (w.letters + 97).tobytes().decode("ascii")
    return {spelled[a:a + n] for a, n in zip(w.start.tolist(), w.length.tolist()) if n >= 3}


def kernel_rows(words: list[str]) -> np.ndarray:
    """The explicit feature map of each word: weights of all three-letter subsequences, 26^3 of them."""
    out = np.zeros((len(words), 26**3), np.float32)
    w = words_of([f"{x}" for x in words])
    for n, rows in w.groups():
        np.add.at(out, (w.text[rows, None], w.codes(n, rows)), _triples(n)[3])
    return out


def toxic_stems(hits: pd.DataFrame, chance: float) -> dict[str, float]:
    """The log-odds of each stem that speaks for toxic sentences, from the words that hold it.

    ``hits`` has a row for each stem and word, with the word's number of toxic and clean sentences. The
    surest stem, of equal ones the longest, is taken first and its words are taken from all others, so
    that none counts for what another explains.
    """
    stem, stems = pd.factorize(hits["stem"])
    word, words = pd.factorize(hits["word"])
    first = np.zeros(len(words), int)
    first[word[::-1]] = np.arange(len(word))[::-1]
    counts = hits[["toxic", "clean"]].to_numpy(float)[first]
    holds: list[list[int]] = [[] for _ in stems]
    within: list[list[int]] = [[] for _ in words]
    for s, w in zip(stem.tolist(), word.tolist()):
        holds[s].append(w)
        within[w].append(s)
    sums = np.array([counts[ws].sum(axis=0) for ws in holds]).reshape(-1, 2)
    queue = [(-beyond_chance(*sums[s], chance), -len(stems[s]), stems[s], s) for s in range(len(stems))]
    heapq.heapify(queue)
    left, out = np.ones(len(words), bool), {}
    while queue and -queue[0][0] >= SURE:
        z, _, name, s = heapq.heappop(queue)
        if -z != beyond_chance(*sums[s], chance):
            continue
        odds = np.log((sums[s][0] + 0.5) / (sums[s][1] + 0.5)) - np.log(chance / (1 - chance))
        if odds < LEAST_ODDS:
            continue
        out[name] = float(odds)
        changed = set()
        for w in holds[s]:
            if left[w]:
                left[w] = False
                for other in within[w]:
                    sums[other] -= counts[w]
                    changed.add(other)
        for other in changed - {s}:
            heapq.heappush(queue, (-beyond_chance(*sums[other], chance), -len(stems[other]), stems[other], other))
    return out


def beyond_chance(toxic, clean, chance):
    """Standard deviations of the toxic count beyond what its total gives by chance; numbers or columns."""
    total = toxic + clean
    return (toxic - total * chance) / (total * (chance * (1 - chance)) + 1) ** 0.5


class Stems:
    """Finds stems in words: runs of letters anywhere, or behind ^ at a word's start. A word has the odds of its surest stem."""

    def __init__(self, odds: dict[str, float]):
        self.tables = []
        for n in range(SHORTEST_STEM, LONGEST_STEM + 1):
            for start in (False, True):
                found = sorted((self._code(np.frombuffer(k.lstrip("^").encode(), np.uint8) - 97, np.zeros(1, int), n)[0], v)
                               for k, v in odds.items() if len(k.lstrip("^")) == n and k.startswith("^") == start)
                if found:
                    self.tables.append((n, start, np.array([c for c, _ in found]), np.array([v for _, v in found], np.float32)))

    @staticmethod
    def _code(letters: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(n):
            out = out * 26 + letters[at + i]
        return out

    def odds(self, words: Words) -> np.ndarray:
        """For each word the log-odds of its surest stem, 0 without one."""
        out = np.zeros(len(words.start), np.float32)
        for n, start, codes, odds in self.tables:
            rows = np.flatnonzero(words.length >= n)
            if start:
                at, word = words.start[rows], rows
            else:
                places = words.length[rows] - n + 1
                word = np.repeat(rows, places)
                at = words.start[word] + np.arange(len(word)) - np.repeat(np.cumsum(places) - places, places)
            seen = self._code(words.letters, at, n)
            place = np.minimum(np.searchsorted(codes, seen), len(codes) - 1)
            found = np.flatnonzero(codes[place] == seen)
            np.maximum.at(out, word[found], odds[place[found]])
        return out


@dataclass
class Model:
    """``weights`` are the support vector machine's over subsequences: its sum over landmarks, each landmark's kernel
    being linear in the word's feature map, added up once. ``scale`` turns the best word and the number of hits of a
    text into a log-odds; ``with_stems`` does so with the stems' odds too, ``cost`` being what each word takes from
    them. The larger of both is the score, so that a word in a veiled spelling, which holds no stem, is worth what
    the machine alone makes of it."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, ...]
    stems: Stems
    with_stems: tuple[float, ...] | None = None
    cost: float = 0.0

    def margins(self, words: Words) -> np.ndarray:
        out = np.full(len(words.start), -1.0, np.float32)
        for n, rows in words.groups():
            weight = _triples(n)[3]
            for at in range(0, len(rows), 1 << 14):
                part = rows[at:at + (1 << 14)]
                out[part] = self.weights[words.codes(n, part)] @ weight + self.bias
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text the cube of its best word's margin, within 0 and 2, the logarithm of its number of sure hits,
        the sum of its stems' odds, and its number of words.

        The cube keeps scores level where the machine is undecided, so that mislabelled documents do not tilt them.
        A word that occurs again adds no odds.
        """
        words = words_of(texts)
        margin = self.margins(words)
        best, hits = np.full(len(texts), -1.0), np.zeros(len(texts))
        np.maximum.at(best, words.text, margin)
        np.add.at(hits, words.text[margin >= 1], 1)
        odds, of_word = np.zeros(len(texts)), self.stems.odds(words)
        at = np.flatnonzero(of_word)
        spelled = [words.letters[a:a + n].tobytes() for a, n in zip(words.start[at].tolist(), words.length[at].tolist())]
        once = list({(t, w): i for t, w, i in zip(words.text[at].tolist(), spelled, at.tolist())}.values())
        np.add.at(odds, words.text[once], of_word[once])
        return np.column_stack([np.clip(best, 0, 2) ** 3, np.log1p(hits), odds, np.bincount(words.text, minlength=len(texts))])

    def scores(self, texts: list[str]) -> np.ndarray:
        e = self.evidence(texts)
        z = _features(e) @ np.array(self.scale)
        if self.with_stems:
            z = np.maximum(z, _features(e, self.cost) @ np.array(self.with_stems))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(e: np.ndarray, cost: float | None = None) -> np.ndarray:
    """What calibration weighs. With a cost, the odds of stems count as far as they exceed what so many words may hold by chance."""
    stems = [] if cost is None else [np.clip(e[:, 2] - cost * e[:, 3], 0, 12)]
    return np.column_stack([e[:, 0], e[:, 1], *stems, np.ones(len(e))])


def _inserted(word: str, random: np.random.Generator) -> list[str]:
    """The word with a foreign letter inserted, and with one doubled."""
    at = int(random.integers(1, len(word)))
    return [word[:at] + "qxzjwvk"[int(random.integers(7))] + word[at:], word[:at] + word[at - 1] + word[at:]]


def train(words: list[str], toxic: np.ndarray, clean: np.ndarray, landmarks: int = 192, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """The support vector machine from words with the number of toxic and clean sentences that hold them.

    A sentence has its document's label, and so does each word in it, though few words make it toxic. So
    a word is a positive instance as often as it stands in toxic sentences beyond what chance explains
    (four standard deviations of what its total would give), if that is most of its sentences, and a
    negative one by the square root of its count in clean ones. Landmarks are the words that speak most for toxic sentences and the
    commonest others. Words that stand in toxic sentences alone also count with inserted letters.
    """
    total = toxic + clean
    rate = (toxic + 0.5) / (total + 5)
    leading = np.lexsort((np.array(words), -rate * np.sqrt(total)))[: landmarks // 2]
    common = np.lexsort((np.array(words), -clean))[: landmarks // 2]
    marks = [words[i] for i in dict.fromkeys([*leading, *common])]
    z = kernel_rows(marks)
    value, vector = np.linalg.eigh((z @ z.T).astype(float))
    keep = value > 1e-6 * value.max()
    to_features = vector[:, keep] / np.sqrt(value[keep])

    random = np.random.default_rng(7)
    extra = [(v, toxic[i] / 4) for i in leading if toxic[i] >= 5 and toxic[i] >= 9 * clean[i] for v in _inserted(words[i], random)]
    names = [*words, *(v for v, _ in extra)]
    chance = toxic.sum() / total.sum() * total
    beyond = np.maximum(0, toxic - chance - 4 * np.sqrt(chance))
    up = np.concatenate([np.where(beyond >= total / 2, beyond, 0), [n for _, n in extra]])
    if not up.any():
        up = np.concatenate([toxic, [n for _, n in extra]])
    down = np.sqrt(np.concatenate([clean, np.zeros(len(extra))]))
    x = np.concatenate([kernel_rows(names[a:a + 2000]) @ z.T for a in range(0, len(names), 2000)]) @ to_features
    x = np.column_stack([x, np.ones(len(x))])
    up, down = up / up.sum(), down / down.sum() * 10
    beta = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps on the squared hinge
        f = x @ beta
        a, b = up * (f < 1), down * (f > -1)
        grad = x.T @ (b * (f + 1) - a * (1 - f)) + ridge * beta
        step = np.linalg.solve((x * (a + b)[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return ((to_features @ beta[:-1]) @ z).astype(np.float32), float(beta[-1])


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """The weights of the features, and the loss that is left with them."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * beta), -2, 2)
    z = np.clip(x @ beta, -30, 30)
    return tuple(float(b) for b in beta), float((np.logaddexp(0, z) - y * z).sum() + 5e-3 * beta @ beta)


def fold(doc_id) -> F.Column:
    """The fold of a document, 0 to 3, from its id alone."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, least_sentences: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on at most ``sample_docs`` labelled documents outside fold 2, chosen by the hash of their ids.

    Folds 0 and 1 train the machine, fold 3 calibrates. Sentences that occur again count once. Stems are
    counted over all words, however rare each is: a toxic stem may stand in no word twice. Rows without
    an id or label are left out; of several labels of one document the largest counts. None if there are
    not both labels to learn from.
    """
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(fold(F.col(id_col)) != 2)
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_docs))
    given = (docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
             .join(F.broadcast(chosen), "_id").select(fold(F.col("_id")).alias("fold"), "label", "text"))  # bounded by sample_docs

    def sentences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes = [], []
            for text in batch.column("text").to_pylist():
                parts = sorted(set(_SENTENCE.split(text)))
                sets = [sorted(word_set(s)) for s in parts]
                words.append([w for s in sets for w in s])
                hashes.append([int.from_bytes(_digest(s), "little", signed=True) for s, ws in zip(parts, sets) for _ in ws])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string())),
                                              pa.array(hashes, pa.list_(pa.int64()))], names=["label", "word", "sentence"])

    rows = given.where("fold < 2").select("label", "text").mapInArrow(sentences, "label int, word array<string>, sentence array<bigint>")
    rows = rows.select("label", F.explode(F.arrays_zip("word", "sentence")).alias("w")).select("label", "w.word", "w.sentence").distinct()
    every = staged(rows.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "toxicity-words")
    counts = (every.where(F.col("toxic") + F.col("clean") >= least_sentences)
              .orderBy(F.desc(F.col("toxic") + F.col("clean")), "word").limit(10 * sample_docs).toPandas())
    if counts.empty or counts["toxic"].sum() == 0 or counts["clean"].sum() == 0:
        return None
    model = Model(*train(counts["word"].tolist(), counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)), (1.0, 0.0, 0.0),
                  Stems(fit_stems(every)))

    kinds = ["best", "hits", "odds", "words"]

    def evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _in_chunks(batch.column("text").to_pylist(), model.evidence)
            yield pa.RecordBatch.from_arrays([*(pa.array(e[:, i]) for i in range(4)), batch.column("label")], names=[*kinds, "label"])

    seen = given.where("fold = 3").select("label", "text").mapInArrow(
        evidence, "best double, hits double, odds double, words double, label int").toPandas()
    if seen["label"].nunique() < 2:
        return model
    e, y = seen[kinds].to_numpy(), seen["label"].to_numpy(float)
    model.scale, _ = _calibrated(_features(e), y)
    _, model.cost, model.with_stems = min((loss, cost, beta) for cost in COSTS for beta, loss in [_calibrated(_features(e, cost), y)])
    return model


def fit_stems(counts: DataFrame) -> dict[str, float]:
    """The stems that speak for toxic sentences, with their log-odds, from ``counts``: all words with their sentences.

    A stem is a run of SHORTEST_STEM to LONGEST_STEM letters anywhere in a word or, with ^ before it, at
    its start. Only those beyond chance come to the driver, with their words.
    """
    toxic, clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return {}
    chance = toxic / (toxic + clean)
    lengths = LONGEST_STEM - SHORTEST_STEM + 1
    runs = (f"transform(sequence(0, length(word) * {lengths} - 1), i -> substring(word, i div {lengths} + 1, i % {lengths} + {SHORTEST_STEM}))")
    starts = f"transform(sequence({SHORTEST_STEM}, {LONGEST_STEM}), n -> concat('^', left(word, n)))"
    stems = F.expr(f"concat(filter(array_distinct({runs}), s -> length(s) >= {SHORTEST_STEM}), "
                   f"filter(array_distinct({starts}), s -> length(s) > {SHORTEST_STEM}))")
    held = counts.select("word", "toxic", "clean", F.explode(stems).alias("stem"))
    beyond = (held.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
              .where(beyond_chance(F.col("t"), F.col("c"), chance) >= SURE).select("stem"))
    return toxic_stems(held.join(beyond, "stem").toPandas().sort_values(["stem", "word"], ignore_index=True), chance)


def _digest(sentence: str) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(sentence)


def _in_chunks(texts: list[str], fn, chars: int = 1 << 19) -> np.ndarray:
    """Apply ``fn`` to lists of texts of about ``chars`` characters together."""
    out, at, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars or i + 1 == len(texts):
            out.append(fn(texts[at:i + 1]))
            at, held = i + 1, 0
    return np.concatenate(out) if out else fn([])


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` of ``docs`` and score, 0 to 1, for every whole text.

    A null or empty text is scored as a text without words. Without a model the score is 0. Each row is
    scored for itself from its text alone; there is one row per row of ``docs``. Other columns are
    ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *carried(keep))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column("_text").to_pylist()
            s = _in_chunks(texts, model.scores) if model else np.zeros(len(texts))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s, pa.float64())], names=[*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    out = given.mapInArrow(score, f"{kinds}, score double")
    return out.select(F.col("_id").alias("doc_id"), *given_back(keep), "score")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
