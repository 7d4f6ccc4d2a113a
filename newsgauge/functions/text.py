"""Text and HTML column functions: whitespace, entities, tags, outlet names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from newsgauge import values as v

# Whitespace as web pages use it: ASCII plus the Unicode spaces, the ideographic one included.
WS_CHARS = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{WS_CHARS}]"
# The same class, written for Java alone: one look into a table and two comparisons decide for most characters.
_WS_SOON = r"[ \t\n\x0b\f\r\x{00a0}[\x{1680}-\x{3000}\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HAN = "[一-龥]"


def anchored(pattern: str) -> str:
    """Make a trailing ``$`` mean end of text; in Java it also matches before a last newline."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def any_of(words) -> str:
    """Alternation of literal words for use in a pattern."""
    return "|".join(w.replace(".", r"\.") for w in words)


def contains_any(c: Column, words) -> Column:
    """The text contains one of the words: plain substring searches, far cheaper than an alternation."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


_WORDS = re.compile(r"[^\\^$.|?*+()\[\]{}]+(?:\|[^\\^$.|?*+()\[\]{}]+)*")
_LAST_GROUP = re.compile(r"\((" + _WORDS.pattern + r")\)\$?\Z")


def matches(c: Column, pattern: str) -> Column:
    """``rlike`` that avoids the regex engine where it can.

    A pattern of literal words only becomes substring searches. One that must end with one of several
    words is tried only on texts that contain such a word.
    """
    if _WORDS.fullmatch(pattern):
        return contains_any(c, pattern.split("|"))
    tail = _LAST_GROUP.search(pattern)
    one_branch = "|" not in re.sub(r"\([^()]*\)", "", pattern)
    found = c.rlike(anchored(pattern))
    if one_branch and tail:
        return contains_any(c, tail[1].split("|")) & found
    return found


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


# Runs that are more than one plain blank: most spaces of a text are one, and replacing it by itself is slow.
_WS_RUN = rf"{_WS_SOON}(?:(?<! )|(?={_WS_SOON})){_WS_SOON}*+"


def squeeze_ws(c: Column) -> Column:
    return F.regexp_replace(c, _WS_RUN, " ")


def strip_tags(c: Column, repl: str = "") -> Column:
    return bind(c, lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, "<[^>]+>", repl)).otherwise(x))


def html_to_text(c: Column) -> Column:
    """Tags become blanks, runs of whitespace one blank."""
    return trim_ws(squeeze_ws(strip_tags(c, " ")))


def decode_entities(c: Column, entities=v.URL_ENTITIES) -> Column:
    """Replace entities in list order, so a list with ``&amp;`` first decodes ``&amp;lt;`` twice.

    Each is looked for by a plain search, a fraction of what its replacement costs, and none in a text without ``&``.
    """
    def one(acc: Column, e: tuple[str, str]) -> Column:
        return bind(acc, lambda x: F.when(F.contains(x, F.lit(e[0])), F.replace(x, F.lit(e[0]), F.lit(e[1]))).otherwise(x))

    if not all(e.startswith("&") for e, _ in entities):
        return reduce(one, entities, c)
    return bind(c, lambda x: F.when(F.contains(x, F.lit("&")), reduce(one, entities, x)).otherwise(x))


def strip_cdata(c: Column) -> Column:
    # one character decides at most places
    return F.regexp_replace(c, r"[<\]](?:(?<=<)!\[CDATA\[|(?<=\])\]>)", "")


def clean_api_text(c: Column) -> Column:
    return trim_ws(decode_entities(strip_tags(c), v.API_ENTITIES))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def unescape_unicode(c: Column) -> Column:
    r"""Turn ``\uXXXX`` escapes, surrogate pairs included, into the characters they stand for."""
    # a lone surrogate is no character: show the replacement character instead
    c = F.regexp_replace(c, r"(?i)\\u(d[89ab][0-9a-f]{2})(?!\\ud[c-f][0-9a-f]{2})", r"\\ufffd")
    c = F.regexp_replace(c, r"(?i)(?<!\\ud[89ab][0-9a-f]{2})\\u(d[c-f][0-9a-f]{2})", r"\\ufffd")
    run = r"(?:\\u[0-9a-fA-F]{4})+"
    decoded = F.transform(
        F.regexp_extract_all(c, F.lit(f"({run})"), F.lit(1)),
        lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE"),
    )
    joined = F.array_join(
        F.zip_with(
            F.split(c, run), decoded, lambda text, chars: F.concat(text, F.coalesce(chars, F.lit("")))
        ),
        "",
    )
    return F.when(F.contains(c, F.lit("\\u")), joined).otherwise(c)


# --- outlet at the end of a title ------------------------------------------------------------------

def last_split(c: Column, sep: str) -> Column:
    """Struct (before, after): the text around the last ``sep`` that is not at the very start; blanks if there is none."""

    def around(x: Column) -> Column:
        after = F.substring_index(x, sep, -1)
        return F.struct(F.left(x, F.length(x) - F.length(after) - len(sep)).alias("before"), after.alias("after"))

    none = F.struct(F.lit("").alias("before"), F.lit("").alias("after"))
    split = bind(c, lambda x: F.when(F.contains(x, F.lit(sep)), around(x)).otherwise(none))
    return bind(split, lambda s: F.when(s["before"] != "", s).otherwise(none))


def split_title_outlet(title: Column, source_tag: Column | None = None) -> Column:
    """Struct (title, media): the outlet behind the last `` - `` or ``_ ``, else the source tag."""
    tag = F.lit(None).cast("string") if source_tag is None else trim_ws(source_tag)

    def named(s: Column) -> Column:
        has_dash = s["dash"]["before"] != ""
        bar_media = trim_ws(s["bar"]["after"])
        has_bar = (s["bar"]["before"] != "") & bar_media.rlike(rf"^[一-龥A-Za-z0-9·（）()]{{2,24}}\z")
        media = F.when(has_dash, trim_ws(s["dash"]["after"])).when(has_bar, bar_media)
        return F.struct(
            F.when(has_dash, trim_ws(s["dash"]["before"])).when(has_bar, trim_ws(s["bar"]["before"])).otherwise(title).alias("title"),
            F.coalesce(blank_to_null(media), blank_to_null(tag), F.lit(v.UNKNOWN_OUTLET)).alias("media"),
        )

    return bind(F.struct(last_split(title, " - ").alias("dash"), last_split(title, "_ ").alias("bar")), named)


# --- outlet-name predicates ------------------------------------------------------------------------

def starts_with_platform(c: Column) -> Column:
    return c.rlike(f"^(?:{any_of(v.PLATFORM_PREFIXES)})")


def is_title_artifact(name: Column) -> Column:
    """The name is a piece of a headline: it holds an underscore or a quotation mark."""
    return name.rlike('[_"“”]')


def is_unreliable_outlet(name: Column) -> Column:
    """Names worth correcting: blank, bare domains, headline pieces, digits, platforms."""
    n = trim_ws(F.coalesce(name, F.lit("")))
    bare_domain = rf"^[a-zA-Z0-9.-]+\.(?i:{v.RAW_DOMAIN_SUFFIXES})(/.*)?\z"
    return (
        (F.length(n) <= 2)
        | (n == v.UNKNOWN_OUTLET)
        | (~n.rlike(HAN) & n.rlike(bare_domain))
        | is_title_artifact(n)
        | n.rlike("[0-9]")
        | starts_with_platform(n)
    )


def is_plausible_outlet(name: Column, allow_platform: Column | bool = False) -> Column:
    """An extracted name may be used: 3-40 characters, some Han, nothing that marks body text."""
    allow = F.lit(allow_platform) if isinstance(allow_platform, bool) else allow_platform
    core = F.regexp_replace(F.regexp_replace(name, v.NAME_LEAD, ""), anchored(v.NAME_TAIL), "")
    return bind(
        trim_ws(core),
        lambda n: F.length(n).between(3, 40)
        & n.rlike(HAN)
        & ~n.rlike('["“”）)（(：:。；;！!？?0-9]')
        & ~n.rlike(v.UI_PHRASES)
        & (allow | ~starts_with_platform(n)),
    )


def clean_outlet(raw: Column) -> Column:
    c = trim_ws(squeeze_ws(decode_entities(raw, v.NAME_ENTITIES)))
    return F.rtrim(F.ltrim(c, F.lit("，。；：:、-_|/")), F.lit("，。；：:、"))


# --- outlet named inside an article page -----------------------------------------------------------

def _first_match(html: Column, *patterns: str) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(html, p, 1)) for p in patterns])


def _source_line_names(html: Column) -> Column:
    """One candidate per source label, in page order; a tail may run over the next label."""
    tails = F.regexp_extract_all(
        html, F.lit(rf"(?s)来源[：:]{WS}*(?=(.{{0,{v.SOURCE_TAIL_CHARS}}}))"), F.lit(1)
    )

    def name_of(tail: Column) -> Column:
        text = F.regexp_replace(unescape_unicode(tail), "<[^>]*>", " ")
        text = F.regexp_replace(text, f"({HAN}){WS}+({HAN})", "$1$2")
        text = F.regexp_extract(text, rf"(?s)^(.*?)(?:{v.SOURCE_STOPS}|{WS}[0-9]|\z)", 1)

        def last_part(whole: Column) -> Column:
            parts = F.filter(F.transform(F.split(whole, "[、，,;；｜|]"), trim_ws), lambda p: p != "")
            return F.coalesce(F.try_element_at(parts, F.lit(-1)), whole)

        return bind(clean_outlet(text), last_part)

    return F.transform(tails, name_of)


def outlet_from_page(html: Column, allow_platform: Column | bool = False) -> Column:
    """The outlet an article page names, by descending trust in the mark; NULL if none is usable.

    Order: ``mediaid`` meta, author-name element, ``nickname``, source labels in the text,
    ``og:site_name`` / ``source`` meta, tail of the page title. A pattern runs only on pages that
    contain its key word.
    """

    def usable(c: Column) -> Column:
        return F.when(is_plausible_outlet(c, allow_platform), c)

    def cleaned(mark: Column) -> Column:
        return bind(mark, lambda m: F.when(is_plausible_outlet(m, allow_platform), clean_outlet(m)))

    name = rf"{WS}*([^<]{{2,40}}){WS}*<"

    def from_marks(low: Column) -> Column:
        def having(words: list[str], value: Column) -> Column:
            return F.when(contains_any(low, words), value)

        labelled = F.filter(_source_line_names(html), lambda n: is_plausible_outlet(n, allow_platform))
        return F.coalesce(
            having(["mediaid"], cleaned(_first_match(html, r'(?i)<meta[^>]*name="mediaid"[^>]*content="([^"]+)"'))),
            having(["author-name"], cleaned(_first_match(
                html,
                rf'(?i)<[^>]*data-testid="[^"]*author-name[^"]*"[^>]*>{name}',
                rf'(?i)<[^>]*class="[^"]*author-name[^"]*"[^>]*>{name}',
            ))),
            having(["nickname"], cleaned(_first_match(
                html,
                rf"""(?i)var{WS}+nickname{WS}*={WS}*[^"']*["']([^"']{{2,40}})["']""",
                rf"""(?i)["']nickname["']{WS}*[:=]{WS}*["']([^"']{{2,40}})["']""",
            ))),
            having(["来源"], F.try_element_at(labelled, F.lit(1))),
            having(['"og:site_name"', '"source"'], cleaned(_first_match(
                html,
                r'(?i)<meta[^>]*property="og:site_name"[^>]*content="([^"]+)"',
                r'(?i)<meta[^>]*name="source"[^>]*content="([^"]+)"',
            ))),
            title_tail_outlet(F.regexp_extract(html, r"(?i)<title>([^<]*)</title>", 1), usable),
        )

    return bind(F.lower(html), from_marks)


def title_tail_outlet(title: Column, usable=None) -> Column:
    """Outlet behind the last `` - ``, ``_``, ``—`` or ``|`` of a page title, the first usable one."""
    if usable is None:
        usable = lambda c: F.when(is_plausible_outlet(c), c)


    def tail(title: Column) -> Column:
        def after(sep: str) -> Column:
            suffix = bind(trim_ws(last_split(title, sep)["after"]), usable)
            return F.when(F.contains(title, F.lit(sep)), suffix)

        return F.coalesce(after(" - "), after("_"), after("—"), after("|"))

    return bind(clean_outlet(title), tail)


# --- names and labels ------------------------------------------------------------------------------

def short_organisation(name: Column, suffix: str = v.LEGAL_SUFFIX) -> Column:
    """Name without its legal form; NULL where nothing is stripped or too little is left."""
    base = trim_ws(name)
    short = trim_ws(F.regexp_replace(base, suffix, ""))
    return F.when((F.length(base) > 4) & (short != base) & (F.length(short) >= 2), short)


def organisation_variants(name: Column, quoted: bool = False, suffix: str = v.LEGAL_SUFFIX) -> Column:
    """Search forms of an organisation name: (quoted form,) the name, the name without legal form."""
    base = trim_ws(name)
    forms = [F.concat(F.lit('"'), base, F.lit('"'))] if quoted else []
    forms += [base, short_organisation(name, suffix)]
    return F.when(base != "", F.array_compact(F.array(*forms))).otherwise(F.array().cast("array<string>"))


def display_label(tier: Column) -> Column:
    """Tier name as shown on screen; unknown tiers pass through."""
    return reduce(lambda acc, kv: acc.when(tier == kv[0], kv[1]), v.DISPLAY_LABELS.items(), F).otherwise(tier)


def score_band(score: Column) -> Column:
    return F.when(score >= 30, "high").when(score >= 15, "ok").otherwise("low")
