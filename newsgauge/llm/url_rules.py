"""URL filters: rules that state host and path, and association rules mined by FP-growth for all other addresses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgauge.llm.common import carried, given_back, query, staged, table

#: Verdict and rule: host, then path from its first slash on.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEFAULT = "allow"
VERDICTS = ("allow", "block")
RULES_AT_ONCE = 50_000


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash sign or the end, ASCII letters lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark, hash sign or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits the host or a parent domain of it and starts the path; else null.

    Of rules of one length the first stated counts.
    """
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")

    def fits(rule: str) -> Column:
        at = rule.index("/")
        return ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))

    longest = sorted(rules, key=lambda r: -len(r[1]))
    found = [F.when(fits(rule), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))) for verdict, rule in longest]
    return F.coalesce(*found)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of an address, at most 15; none for null.

    ``scheme:``, ``top:`` (the last label of the host), ``tail:`` (the last two), ``sub:`` (each of the three labels before those, and
    those before them together), ``path:`` (each of the first four parts with its depth, and those after them together), ``end:``
    (extension or slash), ``query:`` (all parameter names) and ``part:`` where the address names a part. A path part with digits counts as ``num:``
    with the number of digits and the first of them.
    """
    host, path = url_host(url), url_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    before = F.reverse(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))))
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,8}$", ""), "/"), lambda p: p != "")
    number = lambda p: F.concat(F.length(F.regexp_replace(p, "[^0-9]", "")).cast("string"), F.lit(":"), F.regexp_extract(p, "([0-9])", 1))
    depth = F.transform(F.slice(parts, 1, 4), lambda p, i: F.when(p.rlike("[0-9]"), F.concat(F.lit("num:"), number(p)))
                        .otherwise(F.concat(F.lit("path:"), i.cast("string"), F.lit(":"), F.lower(p))))
    keys = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda k: F.lower(F.regexp_extract(k, "(?s)^([^=]*)", 1)))
    keys = F.array_join(F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != ""))), "&")
    ending = F.when(F.endswith(path, F.lit("/")), "/").otherwise(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))

    def named(kind: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(kind + ":"), value))

    single = F.array(
        named("scheme", F.when(F.contains(url, F.lit("://")), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        named("top", F.get(F.reverse(labels), F.lit(0))),
        F.when(F.size(labels) > 1, named("tail", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))),
        named("sub", F.array_join(F.slice(before, 4, 1 << 20), ".")),
        named("path", F.lower(F.array_join(F.slice(parts, 5, 1 << 20), "/"))),
        named("end", F.lower(ending)),
        named("query", keys),
        F.when(F.contains(url, F.lit("#")), F.lit("part:")),
    )
    every = F.concat(F.filter(single, lambda t: t.isNotNull()), F.transform(F.slice(before, 1, 3), lambda x: F.concat(F.lit("sub:"), x)), depth)
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.05,
               longest: int = 4) -> DataFrame:
    """Association rules from token combinations to verdicts, of ``labelled`` (tokens, verdict): tokens, verdict,
    confidence, support (share of the labelled rows with the tokens and the verdict), lift, rank.

    FP-growth finds the combinations that at least ``min_support`` of the rows have, with the verdict
    as one more item. A rule stays if its confidence and lift reach their bounds, it has at most ``longest`` tokens,
    and no rule with part of its tokens says the same with as much confidence: such a rule
    judges every address the longer one does. ``rank`` numbers rules by confidence, support, fewest tokens and text.

    The rows are all labelled ones. Spark spreads FP-growth by item, and what reaches one task are the frequent
    items of rows. An address has at most 15 tokens, so at most 15 / ``min_support`` tokens and 2^15 / ``min_support``
    combinations are frequent, whatever the size of the table. No labelled rows give no rules; rows without tokens and rows
    of another verdict than allow and block are no evidence. A verdict that all rows have is no finding, as its lift is 1.
    """
    verdict = F.concat(F.lit("verdict:"), F.col("verdict"))
    rows = labelled.where(F.col("verdict").isin(*VERDICTS) & (F.size("tokens") > 0))
    rows = staged(rows.select(F.array_append("tokens", verdict).alias("items")), "labelled-urls")
    spark = labelled.sparkSession
    schema = "tokens array<string>, verdict string, confidence double, support double, lift double, rank long"
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit("verdict:")))
    # an antecedent with a verdict in it cannot be: a row has one
    found = found.where((F.size("antecedent") <= longest) & (F.col("lift") >= min_lift))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 9, 1 << 20).alias("verdict"),
                         "confidence", "support", "lift")
    found = staged(found, "association-rules")
    # each rule is looked up under the tokens left by taking away one or more: at most 2^longest parts of it
    parts = reduce(lambda sets, i: F.concat(sets, F.transform(sets, lambda s: F.when(F.get("tokens", F.lit(i)).isNotNull(), F.array_append(s, F.get("tokens", F.lit(i)))))),
                   range(longest), F.array(F.array().cast("array<string>")))
    parts = F.filter(F.array_distinct(parts), lambda s: s.isNotNull() & (F.size(s) > 0) & (F.size(s) < F.size("tokens")))
    shorter = found.select(F.col("tokens").alias("_part"), F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"))
    covered = found.select("tokens", "verdict", "confidence", F.explode(parts).alias("_part")).join(
        shorter, ["_part"]).where("verdict = _verdict AND _confidence >= confidence").select("tokens", "verdict").distinct()
    found = staged(found.join(covered, ["tokens", "verdict"], "left_anti"), "association-rules")
    order = [F.desc("confidence"), F.desc("support"), F.size("tokens"), F.array_join("tokens", " "), F.col("verdict")]
    # the rows of a sorted table are numbered by part and place, which ascends with the order
    return staged(found.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()), "ranked-rules")


def match_rules(rows: DataFrame, rules: DataFrame, tokens: str = "tokens", at_once: int = RULES_AT_ONCE) -> DataFrame:
    """``rows`` with ``mined_rank`` and ``mined_verdict`` of the best rule whose tokens a row has all; null if none.

    Each worker holds an inverted index of ``at_once`` rules (token to the rules with it); a row's tokens
    count up the rules they are in, and a rule fits when its count is its number of tokens. More rules are taken in
    more rounds, best first, each over the same rows, so any number of them gives the same result.
    """
    out = rows.withColumns({"mined_rank": F.lit(None).cast("long"), "mined_verdict": F.lit(None).cast("string")})
    listed = [(r["rank"], r["verdict"], r["tokens"]) for r in rules.orderBy("rank").select("rank", "verdict", "tokens").toLocalIterator()]
    for at in range(0, len(listed), at_once):
        out = _matched(out, listed[at : at + at_once], tokens)
    return out


def _matched(rows: DataFrame, rules: list[tuple[int, str, list[str]]], tokens: str) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, list[int]] = {}
        for i, (_, _, words) in enumerate(rules):
            for word in words:
                index.setdefault(word, []).append(i)
        need = [len(words) for _, _, words in rules]
        known: dict[tuple[str, ...], int] = {}

        def best(words: Sequence[str] | None) -> int:
            """The place of the first rule that fits, or -1. The token sets of frequent tokens met are remembered."""
            key = tuple(w for w in words or () if w in index)
            if key not in known:
                count: dict[int, int] = {}
                for word in key:
                    for i in index[word]:
                        count[i] = count.get(i, 0) + 1
                if len(known) > 100_000:
                    known.clear()
                known[key] = min((i for i, n in count.items() if n == need[i]), default=-1)
            return known[key]

        for batch in batches:
            found = [best(words) for words in batch.column(tokens).to_pylist()]
            before = batch.column("mined_rank").to_pylist()
            ranks = [b if b is not None else rules[i][0] if i >= 0 else None for b, i in zip(before, found)]
            verdicts = [v if v is not None else rules[i][1] if i >= 0 else None for v, i in zip(batch.column("mined_verdict").to_pylist(), found)]
            new = {"mined_rank": pa.array(ranks, pa.int64()), "mined_verdict": pa.array(verdicts, pa.string())}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(j)) for j, n in enumerate(names)], names=names)

    return rows.mapInArrow(work, rows.schema)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, default: str = DEFAULT,
               id_col: str = "page_id", url_col: str = "url", keep: Sequence[str] = (), **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, by (``stated``, ``mined`` or ``default``), mined_rank, and ``keep``.

    A stated rule that fits decides. Other addresses get the verdict of the best mined rule whose tokens they
    all have, else ``default``. The rules are mined from ``labelled`` (url, verdict: allow or block) or, without it,
    from the pages that a stated rule judges. Only the address is read; judging is narrow, so hosts that hold a third of
    the pages are no matter.

    A null address, or one without ``://``, has an empty host and path, fits no stated rule and is judged by
    what tokens it has. Repeated rows stay; an empty table gives an empty result. Other columns are ignored.
    """
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"), *carried(keep))
    stated = stated_rule(url_host(url), url_path(url), rules)
    teachers = rows.select(url_tokens(url).alias("tokens"), stated["verdict"].alias("verdict")) if labelled is None else labelled.select(
        url_tokens(F.col("url").cast("string")).alias("tokens"), "verdict")
    mined = mine_rules(teachers, **mining)
    rows = rows.select("*", url_host(url).alias("host"), url_path(url).alias("path"), stated.alias("_stated"))
    rows = rows.withColumn("_tokens", F.when(F.col("_stated").isNull(), url_tokens(url)))
    out = match_rules(rows.drop("_url"), mined, "_tokens")
    by = F.when(F.col("_stated").isNotNull(), "stated").when(F.col("mined_rank").isNotNull(), "mined").otherwise("default")
    verdict = F.coalesce("_stated.verdict", "mined_verdict", F.lit(default))
    return out.select("page_id", "host", "path", F.col("_stated.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"), "mined_rank", *given_back(keep))


@query("op13_url_rules")
def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
