"""Correction of outlet names and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge import values as v
from newsgauge.functions.text import decode_entities, is_title_artifact, is_unreliable_outlet, outlet_from_page
from newsgauge.functions.urls import is_http, is_redirect
from newsgauge.operators.dedup import flag_first
from newsgauge.operators.joins import attach, is_small
from newsgauge.operators.lookup import first_containing, pairs_array
from newsgauge.session import cut
from newsgauge.sources.payloads import page_block_reason


def outlet_from_domain(text: Column, pairs=v.DOMAIN_OUTLETS) -> Column:
    """Outlet whose domain fragment occurs in a name or link; NULL if none does."""
    return first_containing(F.lower(text), pairs_array(pairs))


def redirect_targets(resolved: DataFrame) -> DataFrame:
    """(url, final_url) of redirect links that end at a page, from ``resolved(url, final_url)``; one row a link.

    A target may be a redirect link itself. Chains are followed by pointer jumping: each round replaces a
    target by its target's target, which halves the way left, so rounds grow with the logarithm of the
    longest chain. Links that end at a redirect link without a target, or go round in a circle, have none.
    """
    known = resolved.where(is_redirect(F.col("url"))).groupBy("url").agg(
        # of several targets a page comes before another redirect link
        F.min(F.struct(F.coalesce(is_redirect(F.col("final_url")), F.lit(True)).alias("more"), F.col("final_url").alias("to"))).alias("_t"))
    known = known.select("url", F.col("_t.to").alias("final_url"), F.col("_t.more").alias("_more"))
    links = known.where(F.col("_more") & (F.col("final_url") != "") & (F.col("final_url") != F.col("url")))
    if links.isEmpty():
        return known.where(~F.col("_more")).select("url", "final_url")
    known = cut(known)
    open_, rounds = known.where("_more").count(), 0
    while True:
        onward = known.select(F.col("url").alias("_from"), F.col("final_url").alias("_to"), F.col("_more").alias("_on"))
        jumped = known.join(onward, F.col("_more") & (F.col("final_url") == F.col("_from")), "left")
        known = cut(jumped.select("url", F.coalesce("_to", "final_url").alias("final_url"), F.coalesce("_on", "_more").alias("_more")))
        left, rounds = known.where("_more").count(), rounds + 1
        # 2^rounds steps have been followed: what is open after as many as there are links is a circle or a dead end
        if left == 0 or 1 << rounds > open_:
            return known.where(~F.col("_more")).select("url", "final_url")


def resolve_links(df: DataFrame, resolved: DataFrame, row_id: str = "ord") -> DataFrame:
    """Replace redirect links by their targets from ``resolved(url, final_url)``."""
    return replace_links(df, redirect_targets(resolved), row_id)


def replace_links(df: DataFrame, targets: DataFrame, row_id: str = "ord") -> DataFrame:
    """Replace redirect links by their ``targets``, see :func:`redirect_targets`.

    Only rows with a redirect link take part in the join; all others pass as they are.
    """
    redirects = F.coalesce(is_redirect(F.col("url")), F.lit(False))
    joined = attach(df.where(redirects), targets, "url", row_id)
    joined = joined.withColumn("url", F.coalesce("final_url", "url")).select(*df.columns)
    return df.where(~redirects).unionByName(joined)


def clean_links(df: DataFrame) -> DataFrame:
    return df.withColumn("url", decode_entities(F.col("url")))


def correct_by_domain(df: DataFrame) -> DataFrame:
    """Replace unreliable outlet names of news rows by the one their name or link domain stands for.
    Adds ``media_fix = 'domain'`` where that happened."""
    fixed = F.coalesce(outlet_from_domain(F.col("media")), outlet_from_domain(F.col("url")))
    usable = (F.col("source") == "news") & is_unreliable_outlet(F.col("media")) & fixed.isNotNull()
    return df.withColumn("_fixed", F.when(usable, fixed)).select(
        *[F.coalesce("_fixed", "media").alias("media") if c == "media" else F.col(c) for c in df.columns],
        F.when(F.col("_fixed").isNotNull(), "domain").alias("media_fix"),
    )


def flag_page_checks(df: DataFrame, row_id: str = "ord") -> DataFrame:
    """Add ``page_check``: news rows whose name is still unreliable, the first row per link."""
    wanted = (F.col("source") == "news") & is_unreliable_outlet(F.col("media")) & is_http(F.col("url"))
    return flag_first(df, [F.col("url")], [F.col(row_id)], row_id, "page_check", wanted)


def correct_by_page(df: DataFrame, pages: DataFrame, row_id: str = "ord", broadcast: bool | None = None) -> DataFrame:
    """Correct flagged rows from landed article pages ``pages(url, final_url, html)``, one per link.

    If the flagged rows are few enough to broadcast, names are read from their pages only. Otherwise both
    names a page may give are read where it is scanned, so that only those, never the page, are shuffled.
    Adds ``page_result``: ``corrected``, ``skipped`` (no usable page or name) or NULL where not checked.
    """
    checks = cut(df.where("page_check").select(row_id, "url", is_title_artifact(F.col("media")).alias("_artifact")))
    usable = pages.select("url", "final_url", "html").where(page_block_reason(F.col("html")).isNull())
    if is_small(checks, "url") if broadcast is None else broadcast:
        named = usable.join(F.broadcast(checks), "url")
        name = outlet_from_page(F.col("html"), F.col("_artifact"))
    else:
        read = {f"_name_{flag}": outlet_from_page(F.col("html"), F.lit(flag)) for flag in (True, False)}
        named = usable.select("url", "final_url", *[c.alias(n) for n, c in read.items()]).join(checks, "url")
        name = F.when(F.col("_artifact"), F.col("_name_True")).otherwise(F.col("_name_False"))
    found = (
        named.select(
            row_id,
            name.alias("_name"),
            F.when(
                (F.col("final_url") != "") & ~is_redirect(F.col("final_url")), F.col("final_url")
            ).alias("_final"),
        )
        # a page landed twice must not double its article
        .groupBy(row_id)
        .agg(F.max(F.struct("_name", "_final")).alias("_found"))
        .select(row_id, "_found.*")
    )
    changed = {"media": F.coalesce("_name", "media"), "url": F.coalesce("_final", "url")}
    return df.join(found, row_id, "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in df.columns],
        F.when(F.col("page_check"), F.when(F.col("_name").isNotNull(), "corrected").otherwise("skipped")).alias(
            "page_result"
        ),
    )


def verification_stats(df: DataFrame) -> DataFrame:
    """checked / corrected / skipped over rows with ``media_fix`` and ``page_result``."""
    return df.agg(
        F.count("page_result").alias("checked"),
        (F.count("media_fix") + F.count_if(F.col("page_result") == "corrected")).alias("corrected"),
        F.count_if(F.col("page_result") == "skipped").alias("skipped"),
    )
