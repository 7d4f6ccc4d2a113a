"""A stored index of grams to articles, for term searches that do not read the texts again.

An index is a folder of batches, each written once (``batch=<name>``). A batch holds

* ``texts``: id and text, in folders by part, sorted by part and numbered within it (``place``);
* ``postings``: for each gram (``GRAM`` characters) and part of the articles rows with the places of the part's
  articles that contain it and their number, in folders by a hash of the gram's first character, sorted by gram.

A part has about ``PART_ROWS`` articles, so a posting row is bounded and a gram that all articles have is
spread over all parts. Places are small numbers however many articles there are, so they stay short when stored.
The grams of a part are gathered where its texts are read, so only whole posting rows are shuffled; a part that is
long or read in two tasks has several rows for a gram. A search reads the folders its terms' grams are in: first
only counts, to choose the rarest grams of each term, then the places of those, then the texts of the parts with
candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsgauge.session import cut

GRAM = 4
PART_ROWS = 2000
SLOTS = 256
SHELVES = 1024
CHOSEN = 2
FILE_ROWS = 1_000_000
LISTED_PARTS = 10_000
GATHER_CHARS = 8_000_000
TASK_PARTS = 4
FOLDER_PARTS = 32
_SCHEMAS = {"postings": "gram string, part int, n int, places array<int>, batch string, slot int",
            "texts": "part int, place int, id bigint, text string, batch string, shelf int"}


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(SLOTS)).cast("int")


def _grams(text: Column, n: int = GRAM) -> Column:
    # each match takes one character, so that none begins within a character of two UTF-16 units
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def _gathered(part: int, places: list[int], texts: list[str]) -> pa.RecordBatch:
    """The posting rows of some texts of a part: each gram once, with the places of the texts that contain it."""
    marks = "\x00" * (GRAM - 1)
    chars = np.frombuffer("".join(x + marks for x in texts).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), [len(x) + len(marks) for x in texts])
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    size = int(seen.sum())  # characters are numbered, so that a gram is a number
    number = (np.cumsum(seen) - 1)[chars]
    at = np.flatnonzero(chars != 0)  # a gram begins with a character of the text
    gram = number[at]
    for k in range(1, GRAM):
        if size ** (k + 1) * len(texts) >= 2**62:
            gram = np.unique(gram, return_inverse=True)[1]
        gram = gram * size + number[at + k]
    if size**GRAM * len(texts) >= 2**62:
        gram = np.unique(gram, return_inverse=True)[1]
    pair = gram * len(texts) + row[at]
    order = np.argsort(pair)
    pair = pair[order]
    first = np.diff(pair, prepend=-1) != 0  # a text counts once for a gram
    pair, order = pair[first], order[first]
    starts = np.flatnonzero(np.diff(pair // len(texts), prepend=-1) != 0)
    spelt = chars[at[order[starts]][:, None] + np.arange(GRAM)]
    width = (1 + (spelt >= 0x80) + (spelt >= 0x800) + (spelt >= 0x10000)).sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(width)]).astype("int32")
    data = spelt.astype("<u4").tobytes().decode("utf-32-le").encode()
    grams = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    held = np.asarray(places, "int32")[pair % len(texts)]
    lists = pa.ListArray.from_arrays(np.append(starts, len(pair)).astype("int32"), held)
    return pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(starts), part, "int32")), lists], ["gram", "part", "places"])


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of texts that come part by part; no more than about ``GATHER_CHARS`` characters are held."""
    part, places, texts, size = None, [], [], 0
    for batch in batches:
        read = zip(*(batch.column(c).to_pylist() for c in ("part", "place")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
        for p, place, text in read:
            if texts and (p != part or size >= GATHER_CHARS):
                yield _gathered(part, places, texts)
                places, texts, size = [], [], 0
            part = p
            places.append(place)
            texts.append(text.decode("utf-8", "replace"))
            size += len(texts[-1])
    if texts:
        yield _gathered(part, places, texts)


def add_articles(articles: DataFrame, text: Column, row_id: str, path: str, batch: str, part_rows: int = PART_ROWS) -> None:
    """Index a batch of articles. Ids are LONGs and must be new; a batch that is written again replaces itself.

    Texts are followed by end marks, so that each of their characters begins a gram, and terms shorter than a gram
    are beginnings of grams. A null text is empty.
    """
    spark = articles.sparkSession
    rows = articles.select(F.col(row_id).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text")).where("id IS NOT NULL")
    parts = max(1, -(-articles.count() // part_rows))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    placed = rows.select(part.alias("part"), "id", "text", (part % SHELVES).alias("shelf")).repartition("shelf")
    place = F.row_number().over(Window.partitionBy("shelf", "part").orderBy("id"))  # a part is bounded
    placed = placed.select("part", place.alias("place"), "id", "text", "shelf")
    placed.write.partitionBy("shelf").option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").parquet(f"{path}/texts/batch={batch}")
    texts = _read(spark, path, "texts").where(F.col("batch") == batch)
    postings = texts.select("part", "place", "text").mapInArrow(_posting_rows, "gram string, part int, places array<int>")
    postings = postings.select("gram", "part", F.size("places").alias("n"), "places", _slot(F.col("gram")).alias("slot"))
    tasks = max(spark.sparkContext.defaultParallelism, parts // TASK_PARTS)
    postings = postings.repartition(tasks, "slot", F.floor(F.col("part") / FOLDER_PARTS)).sortWithinPartitions("slot", "gram", "part")
    postings.write.partitionBy("slot").option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").parquet(f"{path}/postings/batch={batch}")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All batches. With a schema no file is opened but those that a search asks for."""
    return spark.read.schema(_SCHEMAS[kind]).option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")


def match_indexed(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """One row for each indexed article and term it contains: ``id`` and the columns of ``terms`` (``term`` and others).

    Equal to :func:`lookup.match_terms` over the indexed articles. A blank term matches nothing.
    """
    found = cut(terms.where(F.length(F.trim("term")) > 0))
    short = F.length("term") < GRAM
    wanted = cut(found.select("term").distinct().select("term", F.explode(F.when(short, F.array("term")).otherwise(_grams(F.col("term")))).alias("key")))
    slots = [r[0] for r in wanted.select(_slot(F.col("key")).alias("s")).distinct().collect()]  # at most SLOTS
    sizes = [r[0] for r in wanted.select(F.length("key").alias("k")).distinct().collect()]  # at most GRAM
    postings = _read(spark, path, "postings").where(F.col("slot").isin(slots))

    # the rarest grams of each term; a term with a gram that no text has is found nowhere
    counts = postings.select(F.col("gram").alias("key"), "n").join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    counted = wanted.where(F.length("key") == GRAM).join(counts, "key", "left").groupBy("term").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("keys"))
    best = counted.where(F.element_at("keys", 1)["n"] > 0).select("term", F.slice("keys", 1, CHOSEN)["key"].alias("keys"))
    chosen = cut(best.select("term", F.size("keys").alias("need"), F.explode("keys").alias("key")).unionByName(
        wanted.where(F.length("key") < GRAM).select("term", F.lit(1).alias("need"), "key")))

    # a posting row is met under its gram, and under the beginnings that short terms ask for
    hits = None
    for k in sizes:
        keyed = postings.select("batch", "part", "places", F.substring("gram", 1, k).alias("key"))
        more = keyed.join(chosen.where(F.length("key") == k), "key").select("term", "need", "batch", "part", "key", "places")
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        return found.select(F.lit(None).cast("long").alias("id"), *terms.columns).limit(0)
    one, several = hits.where("need = 1"), hits.where("need > 1")
    alone = one.select("term", "batch", "part", F.explode("places").alias("place")).distinct()
    # the lists of a gram in a part are disjoint and bounded together, and at most CHOSEN grams meet
    whole = several.groupBy("term", "need", "batch", "part", "key").agg(F.flatten(F.collect_list("places")).alias("places"))
    lists = whole.groupBy("term", "need", "batch", "part").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == F.col("need"))
    shared = F.aggregate(F.slice("lists", 2, CHOSEN), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    together = lists.select("term", "batch", "part", F.explode(shared).alias("place"))
    candidates = cut(alone.unionByName(together))

    parts = candidates.select("part").distinct().limit(LISTED_PARTS + 1).collect()
    texts = _read(spark, path, "texts")
    if len(parts) <= LISTED_PARTS:  # more of them leave little to skip
        listed = [r["part"] for r in parts]
        texts = texts.where(F.col("shelf").isin(sorted({x % SHELVES for x in listed})) & F.col("part").isin(listed))
    kept = texts.select("batch", "part", "place", "id", "text").join(candidates, ["batch", "part", "place"]).where(F.contains("text", F.col("term")))
    return kept.select("id", "term").join(found, "term").select("id", *terms.columns)
