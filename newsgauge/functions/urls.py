"""URL column functions, written as plain patterns so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgauge import values as v
from newsgauge.functions.text import any_of, bind, trim_ws

_HEAD = r"(?i)^https?:[/\\]*(?:[^/?#\\@]*@)?"
# a host and an optional port, then the end or a delimiter
_HOST = _HEAD + r"([^/?#\\:@\s<>^|%\[\]]+)(?::[0-9]*)?(?:[/?#\\]|\z)"
_PATH = _HEAD + r"[^/?#\\]+([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL; blank if there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def site(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def strip_query(query: Column, params=v.TRACKING_PARAMS) -> Column:
    """Query string without tracking parameters and empty pieces; every name gets its ``=``."""
    q = F.regexp_replace(query, rf"(?:^|(?<=&))(?:{any_of(params)})(?:=[^&]*)?(?=&|\z)", "")
    q = F.regexp_replace(F.regexp_replace(q, "&+", "&"), r"^&|&\z", "")
    return F.regexp_replace(q, r"(^|&)([^&=]+)(?=&|\z)", "$1$2=")


def canonical_url(url: Column, trim: bool = True) -> Column:
    """Key that is equal for links to the same page.

    Keeps the host without ``www.``, the path and the query without tracking parameters; drops
    scheme, port and fragment. Text that is no URL loses only its scheme and ``www.``.
    """
    url = F.coalesce(url, F.lit(""))
    full = _with_scheme(url)
    path = F.regexp_replace(F.regexp_extract(full, _PATH, 1), r"\\", "/")
    query = F.when(F.contains(full, F.lit("?")), strip_query(F.regexp_extract(full, _QUERY, 1))).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", "")
    other = trim_ws(bare) if trim else bare

    def key(parts: Column) -> Column:
        rest = F.concat(
            F.when(parts["path"] == "", "/").otherwise(parts["path"]),
            F.when(parts["query"] == "", "").otherwise(F.concat(F.lit("?"), parts["query"])),
        )
        return F.when(parts["domain"] != "", F.concat(parts["domain"], rest)).otherwise(other)

    return bind(F.struct(site(full).alias("domain"), path.alias("path"), query.alias("query")), key)


def dedup_url(url: Column, n: int | None = None) -> Column:
    """Canonical key as the near-duplicate merge compares it: whole, or its first ``n`` characters."""
    key = canonical_url(url, trim=False)
    return key if n is None else F.substring(key, 1, n)


def is_http(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def is_redirect(url: Column) -> Column:
    return F.contains(url, F.lit(v.REDIRECT_HOST))


def redirect_id(url: Column) -> Column:
    """Article id in a redirect link; blank if there is none."""
    return F.regexp_extract(url, r"/articles/([^?]+)", 1)
