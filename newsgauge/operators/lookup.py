"""Dictionary lookups by containment, first entry wins.

A containment test is no equi-join key, and a nested-loop join would pair every row with every entry.
Two plans avoid that, chosen by the counted size of the dictionary:

* up to ``INLINE_ENTRIES`` names or ``INLINE_TERMS`` terms: the dictionary becomes one constant array inside the expression,
  tested row by row in a narrow stage;
* above: both sides are turned into substrings of the lengths that occur and joined on equality.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.functions.text import bind
from newsgauge.operators.joins import SALTS, salt_of

INLINE_ENTRIES = 2000  # names are short and distinct
INLINE_TERMS = 1000  # texts are long: about here the substring plan becomes the faster one
INLINE_CHARS = 200_000  # what one literal in a plan may hold


def constant_array(rows: list[dict], schema: str) -> Column:
    """A constant array of structs, folded to a literal when the query is planned."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def pairs_array(pairs) -> Column:
    return constant_array([{"k": k, "v": x} for k, x in pairs], "k:string,v:string")


def first_containing(text: Column, pairs: Column) -> Column:
    """Value of the first pair whose key occurs in ``text``; NULL if none does."""
    return bind(text, lambda x: F.try_element_at(F.filter(pairs, lambda e: F.contains(x, e["k"])), F.lit(1))["v"])


def _bounded(df: DataFrame, column: str, limit: int):
    """The rows of a table if they are at most ``limit`` with at most INLINE_CHARS characters in ``column``, else None.

    Never reads more rows than that.
    """
    size = df.select(F.length(column).alias("n")).limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df.collect() if size[0] <= limit and size[1] <= INLINE_CHARS else None


def _entries(dictionary: DataFrame) -> DataFrame:
    """Dictionary entries that can match: a blank key, which every text contains, is none."""
    return dictionary.select("ord", "key", "value").where(F.length(F.trim("key")) > 0)


def _substrings(c: Column, sizes: list[int]) -> Column:
    """All distinct substrings of ``c`` with one of the given lengths, in one pass per length."""
    each = [F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sizes]
    return F.array_distinct(F.concat(*each)) if each else F.array().cast("array<string>")


def _lengths(df: DataFrame, column: str) -> list[int]:
    """Distinct text lengths; their number is bounded by the longest entry."""
    return sorted(r[0] for r in df.select(F.length(column).cast("int")).distinct().collect() if r[0])


def _gram_join(left: DataFrame, right: DataFrame, gram: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join on a substring that may be very common on the left and is rare on the right."""
    left = left.withColumn("_salt", salt_of(F.col(spread_by), salts))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [gram, "_salt"]).drop("_salt")


def first_match(names: DataFrame, name: str, dictionary: DataFrame, both_ways: bool = False,
                inline: int = INLINE_ENTRIES) -> DataFrame:
    """Add ``value`` to a table of **distinct** names: exact key, else first key in ``ord`` order that
    the name contains (or, with ``both_ways``, that contains the name). NULL where nothing matches."""
    dictionary = _entries(dictionary)
    small = _bounded(dictionary, "key", inline)
    if small is not None:
        small = sorted(small, key=lambda r: (r["ord"], r["key"], r["value"] or ""))
        entries = constant_array([{"k": r["key"], "v": r["value"]} for r in small], "k:string,v:string")
        n = F.col(name)
        hits = F.filter(
            entries,
            lambda e: (F.contains(n, e["k"]) | F.contains(e["k"], n)) if both_ways else F.contains(n, e["k"]),
        )
        exact = F.filter(hits, lambda e: e["k"] == n)
        value = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(hits, F.lit(1)))["v"]
        return names.withColumn("value", value)

    keys = dictionary
    inside = names.select(name, F.explode(_substrings(F.col(name), _lengths(keys, "key"))).alias("key"))
    hits = _gram_join(inside, keys, "key", name).where(F.contains(F.col(name), F.col("key"))).select(
        name, F.struct((F.col(name) != F.col("key")).alias("inexact"), "ord", "key", F.coalesce("value", F.lit("")).alias("v")).alias("ord"), "value"
    )
    if both_ways:
        around = keys.select(
            "ord", "key", "value", F.explode(_substrings(F.col("key"), _lengths(names, name))).alias(name)
        )
        hits = hits.unionByName(names.select(name).join(around, name).select(name, F.struct(
            (F.col(name) != F.col("key")).alias("inexact"), "ord", "key", F.coalesce("value", F.lit("")).alias("v")).alias("ord"), "value"))
    best = hits.groupBy(name).agg(F.min_by("value", "ord").alias("value"))
    return names.join(best, name, "left")


def match_terms(articles: DataFrame, text: Column, row_id: str, terms: DataFrame,
                inline: int = INLINE_TERMS) -> DataFrame:
    """One row per article and contained term: the article's columns plus those of ``terms``.

    ``terms`` needs a text column ``term``; its other columns come along. Texts are searched whole. A
    blank term matches nothing.
    """
    fields = terms.schema.fields
    terms = terms.where(F.length(F.trim("term")) > 0)
    rows = _bounded(terms, "term", inline)
    if rows is not None:
        schema = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields)
        entries = constant_array([r.asDict() for r in rows], schema)
        hits = F.filter(entries, lambda e: F.contains(text, e["term"]))
        return articles.withColumn("_hit", F.explode(hits)).select(*articles.columns, "_hit.*")

    # every term is anchored by its first 1, 2, 4, 8 or 16 characters; an article's distinct substrings of
    # those lengths find its candidate terms by equality, and the whole text decides
    anchored = terms.withColumn("_k", _anchor_length(F.col("term")))
    kinds = [r[0] for r in anchored.select("_k").distinct().collect()]  # at most five
    anchors = anchored.select(F.expr("substring(term, 1, _k)").alias("_gram"), "term").distinct()
    grams = articles.select(row_id, F.explode(F.filter(_substrings(text, sorted(kinds)), _may_be_in(anchors, "_gram"))).alias("_gram"))
    candidates = _gram_join(grams, anchors, "_gram", row_id).groupBy(row_id).agg(F.collect_set("term").alias("_terms"))
    found = articles.join(candidates, row_id).select(
        *articles.columns, F.explode(F.filter("_terms", lambda t: F.contains(text, t))).alias("term")
    )
    # a term may be listed for several subjects, and be common: spread its articles as well
    return _gram_join(found, terms, "term", row_id).select(*articles.columns, *[f.name for f in fields])


def _may_be_in(df: DataFrame, column: str, words: int = 1 << 14):
    """A test that all values of ``column`` pass and few others do: one bit for each of 2^20 hashes.

    The bits are one literal of ``words`` LONGs, whatever the table's size, so values are dropped within
    their row, before anything is exploded or shuffled.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(words * 64))
    word = F.shiftright(bit, 6).cast("int")
    one = F.call_function("shiftleft", F.expr("1L"), F.pmod(bit, F.lit(64)).cast("int"))
    held = [0] * words
    for r in df.select(word.alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most ``words`` rows
        held[r["w"]] = r["b"]
    bits = F.from_json(F.lit(json.dumps(held)), "array<bigint>")

    def test(value: Column) -> Column:
        at = F.pmod(F.xxhash64(value), F.lit(words * 64))
        mine = F.get(bits, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", mine, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(1) == 1

    return test


def _anchor_length(term: Column) -> Column:
    n = F.length(term)
    return F.when(n >= 16, 16).when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
