"""SQL expressions of the checking engine for rules that several queries share."""

from __future__ import annotations

from newsgauge import values as v
from newsgauge.catalogue.views import quote, sql_array
from newsgauge.functions.text import WS, anchored, any_of


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(anchored(pattern))})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {quote(rf'^{WS}+|{WS}+\z')}, '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, {quote(WS + '+')}, ' ', 'g')"


def strip_tags(x: str, repl: str = "") -> str:
    return f"regexp_replace({x}, '<[^>]+>', {quote(repl)}, 'g')"


def decode(x: str, entities) -> str:
    for k, c in entities:
        x = f"replace({x}, {quote(k)}, {quote(c)})"
    return x


def starts_with_platform(x: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {quote(p)})" for p in v.PLATFORM_PREFIXES) + ")"


def unreliable(x: str) -> str:
    t = trim(x)
    return (
        f"(length({t}) <= 2 OR {t} = '未知来源' OR {starts_with_platform(t)} OR contains({t}, '_') "
        f"OR regexp_matches({t}, '[\"“”0-9]') OR (NOT regexp_matches({t}, '[一-龥]') "
        f"AND regexp_matches({t}, '(?i)^[a-z0-9.-]+\\.({v.RAW_DOMAIN_SUFFIXES})(/.*)?\\z')))"
    )


def plausible(x: str, allow: str = "false") -> str:
    n = trim(
        f"regexp_replace(regexp_replace({x}, {quote(v.NAME_LEAD)}, ''), {quote(anchored(v.NAME_TAIL))}, '')"
    )
    return (
        f"(length({n}) BETWEEN 3 AND 40 AND regexp_matches({n}, '[一-龥]') "
        f"AND NOT regexp_matches({n}, '[\"“”）)（(：:。；;！!？?0-9]') AND NOT regexp_matches({n}, {quote(v.UI_PHRASES)}) "
        f"AND ({allow} OR NOT {starts_with_platform(n)}))"
    )


def clean_name(x: str) -> str:
    x = trim(squeeze(decode(x, v.NAME_ENTITIES)))
    x = f"regexp_replace({x}, '^[，。；：:、\\-_|/]+', '')"
    return f"regexp_replace({x}, '[，。；：:、]+\\z', '')"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def site(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def canonical(u: str) -> str:
    full = f"(CASE WHEN starts_with({u}, 'http') THEN {u} ELSE 'https://' || {u} END)"
    path = f"regexp_extract({full}, '(?i)^https?://[^/?#]+([^?#]*)', 1)"
    pieces = f"string_split(regexp_extract({full}, '^[^?#]*\\?([^#]*)', 1), '&')"
    kept = (
        f"list_transform(list_filter({pieces}, lambda p: p <> '' AND NOT list_contains({sql_array(v.TRACKING_PARAMS)}, "
        "string_split(p, '=')[1])), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    )
    return (
        f"({site(full)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END)"
    )


def first_pair(x: str, pairs, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(
        f"WHEN contains({x}, {quote(k)}) THEN {quote(name)}" for k, name in pairs
    ) + f" ELSE {otherwise} END"


def words_contained(x: str, words) -> str:
    return f"len(list_filter({sql_array(tuple(words))}, lambda w: contains({x}, w)))"


def any_word(x: str, words) -> str:
    return matches(x, any_of(words))


def noise(title: str, snippet: str) -> str:
    text = f"({title} || {snippet})"
    return "CASE " + " ".join(f"WHEN {matches(text, p)} THEN {quote(r)}" for p, r in v.NOISE_RULES) + " END"


def tier_rank(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {quote(t)} THEN {i}" for i, t in enumerate(v.TIERS)) + " ELSE 99 END"


def rule_tier(name: str, cities=()) -> str:
    """Domain, place and industry rules, unclassified otherwise."""
    local = f"WHEN {any_word(name, cities)} THEN '地方'" if cities else ""
    return (
        f"COALESCE({first_pair(f'lower({name})', v.DOMAIN_TIERS)}, "
        f"CASE WHEN {any_word(name, v.PAPER_WORDS)} THEN CASE WHEN {any_word(name, v.PROVINCES)} THEN '省部级' {local} ELSE '省部级' END "
        f"WHEN {any_word(name, v.INDUSTRY_WORDS)} THEN '行业' END, '未分类')"
    )


def label_tier(x: str) -> str:
    return f"CASE WHEN {x} = '微信公众号' THEN '行业' WHEN list_contains({sql_array(v.LABEL_TIERS)}, {x}) THEN {x} ELSE '未分类' END"


def score(rows: str) -> str:
    """Subquery: ``rows`` with ``score`` and the explanation joined to ``detail``."""
    text = "(title || snippet)"
    excluded = "CASE " + " ".join(
        f"WHEN {matches('title', p)} OR {matches(text, p)} THEN {quote(p)}" for p in v.EXCLUDE_PATTERNS
    ) + " END"
    low = " OR ".join(f"{matches('title', p)} OR {matches('media', p)}" for p in v.LOW_QUALITY_PATTERNS)
    known = any_word("link_host", v.KNOWN_NEWS_DOMAINS)
    facts = f"""SELECT *, {excluded} AS excluded, ({low}) AS low, length(title) AS chars,
      {words_contained('title', v.EVENT_WORDS)} AS events, {words_contained('title', v.PROGRESS_WORDS)} AS progress,
      (source = 'news' AND (regexp_matches(media, '[报网台刊社]\\z') OR contains(media, '新华') OR contains(media, '人民') OR contains(media, '央视'))) AS formal,
      contains(link_host, '.gov.cn') AS gov, {known} AS known
      FROM (SELECT *, {host("CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END")} AS link_host FROM {rows})"""
    points = """CASE WHEN chars BETWEEN 10 AND 29 THEN 10 WHEN chars BETWEEN 5 AND 39 THEN 5 ELSE 0 END
      + CASE WHEN events >= 2 THEN 30 WHEN events = 1 THEN 20 ELSE 0 END + CASE WHEN progress >= 2 THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches(title, '[-—:：]') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(title, '[！!]') THEN 2 ELSE 0 END
      + CASE WHEN source = 'news' THEN 5 WHEN source = 'wechat' AND events > 0 THEN 7 WHEN source = 'wechat' THEN 2 ELSE 0 END
      + CASE WHEN formal THEN 5 ELSE 0 END + CASE WHEN gov THEN 8 ELSE 0 END + CASE WHEN known THEN 5 ELSE 0 END"""
    detail = """concat_ws('; ', CASE WHEN chars BETWEEN 10 AND 29 THEN '标题长度优(10-29字)' WHEN chars BETWEEN 5 AND 39 THEN '标题长度正常' END,
      CASE WHEN events >= 2 THEN '多事件词命中(' || events || '个)' WHEN events = 1 THEN '报道事件词命中' END,
      CASE WHEN progress >= 2 THEN '进展描述+' || progress END, CASE WHEN source = 'news' THEN '新闻源' END,
      CASE WHEN formal THEN '正规媒体' END, CASE WHEN source = 'wechat' AND events > 0 THEN '微信+事件词' END,
      CASE WHEN gov THEN '政府网站' END, CASE WHEN known THEN '知名媒体域名' END)"""
    return f"""(SELECT *, CASE WHEN excluded IS NOT NULL THEN -100 WHEN low THEN -50 WHEN chars < 5 THEN 0 ELSE {points} END AS score,
      CASE WHEN excluded IS NOT NULL THEN '绝对排除: ' || excluded WHEN low THEN '低质量源排除'
        WHEN chars < 5 THEN '标题过短(<5字)' ELSE {detail} END AS detail FROM ({facts}))"""
