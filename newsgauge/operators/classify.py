"""Outlet name -> tier."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.text import any_of, trim_ws
from newsgauge.operators.joins import attach
from newsgauge.operators.lookup import constant_array, first_containing, first_match, pairs_array
from newsgauge.session import cut


def domain_tier(name: Column, pairs=v.DOMAIN_TIERS) -> Column:
    return first_containing(F.lower(name), pairs_array(pairs))


def newspaper_tier(name: Column, cities=(), provinces=v.PROVINCES) -> Column:
    """Papers by place: a province or no known place is provincial, a city is local.

    ``cities``: their names, or whether the name contains one.
    """
    tier = F.when(name.rlike(any_of(provinces)), v.PROVINCIAL)
    if isinstance(cities, Column):
        tier = tier.when(cities, v.LOCAL)
    elif cities:
        listed = constant_array([{"c": c} for c in cities], "c:string")
        tier = tier.when(F.exists(listed, lambda e: F.contains(name, e["c"])), v.LOCAL)
    return F.when(name.rlike(any_of(v.PAPER_WORDS)), tier.otherwise(v.PROVINCIAL))


def industry_tier(name: Column, words=v.INDUSTRY_WORDS) -> Column:
    return F.when(name.rlike(any_of(words)), v.INDUSTRY)


def label_tier(label: Column) -> Column:
    """A label from outside: the account tier counts as industry, unknown tiers as unclassified."""
    return F.when(label == v.WECHAT_TIER, v.INDUSTRY).when(label.isin(*v.LABEL_TIERS), label).otherwise(v.UNCLASSIFIED)


def rule_tiers(names: DataFrame, dictionary: DataFrame | None = None, cities=()) -> DataFrame:
    """Tier per outlet of a table with distinct ``media`` by dictionary, domain, place and industry rules, as ``rule``.

    ``cities`` is a list of names or a table with a column ``city``, of any size.
    """
    outlets = names.select("media", trim_ws(F.col("media")).alias("_name"))
    if dictionary is None:
        outlets = outlets.withColumn("value", F.lit(None).cast("string"))
    else:
        outlets = first_match(outlets, "_name", dictionary, both_ways=True)
    if isinstance(cities, DataFrame):
        listed = cities.select(F.lit(0).alias("ord"), F.col("city").alias("key"), F.lit(v.LOCAL).alias("value"))
        outlets = first_match(outlets.withColumnRenamed("value", "_listed"), "_name", listed)
        outlets = outlets.withColumnsRenamed({"value": "_city", "_listed": "value"})
        cities = F.col("_city").isNotNull()
    name = F.col("_name")
    rules = F.coalesce(
        F.col("value"), domain_tier(name), newspaper_tier(name, cities), industry_tier(name),
        F.lit(v.UNCLASSIFIED),
    )
    return outlets.select("media", F.when(name == "", v.UNCLASSIFIED).otherwise(rules).alias("rule"))


def with_labels(outlets: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``category`` and ``labelled`` of outlets with a ``rule``: external labels place what the rules did not."""
    if labels is None:
        return outlets.select("media", F.col("rule").alias("category"), F.lit(False).alias("labelled"))
    given = labels.groupBy("media").agg(F.min("category").alias("_label"))
    asked = (F.col("rule") == v.UNCLASSIFIED) & F.col("_label").isNotNull()
    return outlets.join(given, "media", "left").select(
        "media", F.when(asked, label_tier(F.col("_label"))).otherwise(F.col("rule")).alias("category"), asked.alias("labelled"))


def classify_outlets(names: DataFrame, dictionary: DataFrame | None = None, cities=(),
                     labels: DataFrame | None = None) -> DataFrame:
    """Tier per outlet of a table with distinct ``media``: the rules, then the external labels for what is
    left. Adds ``category`` and ``labelled``."""
    return with_labels(rule_tiers(names, dictionary, cities), labels)


def with_category(df: DataFrame, row_id: str = "ord", dictionary: DataFrame | None = None, cities=(),
                  labels: DataFrame | None = None, labelled: bool = False, store: str | None = None) -> DataFrame:
    """Add ``category``, and with ``labelled`` whether an external label was asked for it. Each distinct outlet is
    classified once and joined back; with a ``store`` (a folder), outlets that an earlier run has classified are read from it."""
    names = df.select("media").distinct()
    if store is None:
        outlets = classify_outlets(names, dictionary, cities, labels)
    else:
        outlets = with_labels(stored_tiers(store, names, dictionary, cities), labels)
    return attach(df, outlets if labelled else outlets.select("media", "category"), "media", row_id)


# --- outlets kept between runs ---------------------------------------------------------------------------------

_STORED = "media string, rule string, rules string"


def rules_version(dictionary: DataFrame | None = None, cities=()) -> str:
    """A name for the rules: equal for equal dictionaries, cities and fixed lists, whatever the order of rows."""
    fixed = [v.DOMAIN_TIERS, v.PROVINCES, v.PAPER_WORDS, v.INDUSTRY_WORDS, () if isinstance(cities, DataFrame) else sorted(cities)]
    parts = [repr(fixed)]
    for table in (dictionary, cities):
        if isinstance(table, DataFrame):
            row = F.xxhash64(*[F.col(c) for c in sorted(table.columns)]).cast("decimal(38,0)")
            parts.append(str(tuple(table.agg(F.count("*"), F.sum(row), F.bit_xor(row.cast("bigint"))).first())))
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def stored_tiers(path: str, names: DataFrame, dictionary: DataFrame | None = None, cities=()) -> DataFrame:
    """``rule_tiers`` of distinct names, of which only those are classified that the store at ``path`` does not have by the same rules.

    The store has a folder for each version of the rules; a run appends the outlets that are new to it, so other files stay
    as they are. Labels are no part of it: they are joined when the tiers are read. Runs at one time may both append a
    name; equal rules gave both rows, and one is read. A null name is never stored.
    """
    spark = names.sparkSession
    version = rules_version(dictionary, cities)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rules={version}")

    def known() -> DataFrame:
        stored = spark.read.schema(_STORED).option("basePath", path).parquet(f"{path}/rules={version}")
        return stored.groupBy("media").agg(F.min("rule").alias("rule"))

    named = names.where(F.col("media").isNotNull())
    kept = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    fresh = cut(named.join(known(), "media", "left_anti") if kept else named)
    if not fresh.isEmpty():
        rule_tiers(fresh, dictionary, cities).write.mode("append").parquet(f"{path}/rules={version}")
    elif not kept:
        return rule_tiers(names, dictionary, cities)
    return known().join(names, "media", "left_semi").unionByName(rule_tiers(names.where(F.col("media").isNull()), dictionary, cities))


def unlabelled_outlets(outlets: DataFrame) -> DataFrame:
    """Outlets still to be labelled by hand or by a model."""
    return outlets.where((F.col("category") == v.UNCLASSIFIED) & ~F.col("labelled")).select("media")


def tier_rank(tier: Column) -> Column:
    ranks = reduce(lambda acc, it: acc.when(tier == it[1], it[0]), enumerate(v.TIERS), F)
    return ranks.otherwise(v.UNKNOWN_TIER_RANK)
