"""Pages, toxicity, secrets, personal data, near copies, search and the pipeline against plain restatements."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from newsgauge import llm
from newsgauge.llm import near_dup, toxicity
from newsgauge.llm.automaton import compile_rules
from newsgauge.llm.boosting import BoostedTrees
from newsgauge.llm.components import components
from newsgauge.llm.impact_search import ImpactIndex, top_k
from newsgauge.llm.near_dup import jaccard_join, least_matches, minimum_hashes, shingles, word_bounds
from newsgauge.llm.page_text import extract_main_text, page_blocks, repeated
from newsgauge.llm.personal_data import KINDS, base_spans, candidates, find_personal_data, fit_judge, luhn
from newsgauge.llm.secret_scan import RULES, find_secrets, masked, scanner

SF = "/root/testdata/sf0.001"


# --- pages

def test_page_blocks():
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>x</a><article><header><h1>H &amp; i</h1></header>"
            "<p>a<br>b<div class='user-comments'><p>c</p></div><p>d &lt; e<script>var t='</p>'</script></article>"
            "<div id=side-ad>q</div>tail<!-- c --><form>f</form>")
    assert [t for r, t in page_blocks(page) if r == 2] == ["H & i", "a b", "d < e"]
    page = ("<body class='has-sidebar'><nav>n<main class='with-sidebar'><article class='post comments-open'>x<aside>y</aside></article>"
            "<section id=comments><article class=comment>c1</article></section></main>")
    assert [t for r, t in page_blocks(page) if r == 2] == ["x"]
    assert page_blocks("") == [] and page_blocks("<p>a < b &am") == [(1, "a < b &am")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=6), st.sampled_from([1, 2, 4]))
def test_repeated_runs(streams, depth):
    want = []
    for s in streams:
        cover = [False] * len(s)
        for i in range(len(s) - depth + 1):
            if any(s[i:i + depth] == o[j:j + depth] for o in streams if o != s for j in range(len(o) - depth + 1)):
                cover[i:i + depth] = [True] * depth
        want.append(cover)
    assert [c.tolist() for c in repeated(streams, depth)] == want


@pytest.mark.parametrize("shard_chars", [4_000_000, 700])
def test_boilerplate_without_an_article(spark, shard_chars):
    """Pages of plain blocks: what the host repeats goes, however many shards it has; unique runs stay."""
    notice = "all rights reserved by the owner of this fine little site"
    rows = [(i, "http://a.example/%d" % i, f"<div>{notice}</div><div>story {i} tells of thing {i * 7}</div>", "x") for i in range(12)]
    rows += [(90, None, "<div>no url</div>", "x"), (91, "http://b.example/", None, "x"), (92, "http://c.example/", f"<div>{notice}</div>", "x"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard string")
    got = Counter((r["page_id"], r["text"]) for r in extract_main_text(pages, shard_chars=shard_chars).collect())
    want = Counter((i, f"story {i} tells of thing {i * 7}") for i in range(12)) + Counter([(90, "no url"), (91, ""), (92, notice), (0, "story 0 tells of thing 0")])
    assert got == want
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("few_runs", [200_000, 0])
def test_repeats_are_those_of_the_whole_host(spark, few_runs):
    """A passage on two pages of a host is seen in whichever shards they are; equal pages count as one."""
    shared = "this passage stands on exactly two pages of the whole host"
    rows = [(i, "http://a.example/%d" % i, f"<div>{shared if i in (3, 17) else ''} {i} alone {i * 7}</div>") for i in range(40)]
    rows += [(i, "http://a.example/%d" % i, f"<article>{i if i < 52 else 52} {shared} of pages with an article</article>") for i in range(50, 54)]
    rows += [(i, "http://b.example/%d" % i, "<div>one text that all pages of this other host have in full</div>") for i in range(60, 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = (sorted(map(tuple, extract_main_text(pages, few_runs=few_runs, shard_chars=n, count_all=True).collect()))
                    for n in (4_000_000, 60))
    assert whole == dealt
    for n in (4_000_000, 60):  # the same texts when only pages without an article ask; a passage may stand in an article too
        asked = sorted(map(tuple, extract_main_text(pages, few_runs=few_runs, shard_chars=n).collect()))
        assert [r[:3] for r in asked] == [r[:3] for r in whole]
        assert [r for r in asked if not 50 <= r[0] < 54] == [r for r in whole if not 50 <= r[0] < 54]
    assert {t for i, _, t, _ in dealt if i in (3, 17)} == {"3 alone 21", "17 alone 119"}
    assert all(n >= 11 for i, _, _, n in dealt if 50 <= i < 54) and all(t.startswith("one text") for i, _, t, _ in dealt if i >= 60)


@pytest.mark.parametrize("shard_chars", [4_000_000, 60])
def test_pages_with_an_article_are_asked_too(spark, shard_chars):
    """What one page without an article shares with the frame of a page with one goes; hosts do not meet."""
    shared = "subscribe now to all of the stories of this house"
    rows = [(1, "http://a.example/1", f"<div>{shared}</div><div>plain story one</div>"), (4, "http://b.example/4", f"<div>{shared}</div>"),
            (2, "http://a.example/2", f"<div>{shared}</div><article>marked story two</article>"), (3, "http://a.example/3", "<nav>n</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages, shard_chars=shard_chars).collect()}
    assert got == {1: "plain story one", 2: "marked story two", 3: "", 4: shared}


def test_names_that_say_little():
    """Names such as no-sidebar, headers and formulas within an article, and unclosed elements lose no text."""
    assert page_blocks("<div class='content no-sidebar has-widget'><p>Hello</p></div>") == [(1, "Hello")]
    page = "<article><div class='entry-header'><h1>Head</h1></div><p>x <math>a+b</math></p><object><p>y</p></article><div class='page-header'>z</div>"
    assert [t for r, t in page_blocks(page) if r == 2] == ["Head", "x a+b", "y"]
    assert page_blocks("<p>a</p><script>var b") == [(1, "a")]


def test_page_query_rows(spark):
    """The query's rows equal a plain reading of each page's article element."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(b for b in blocks if b)
        want[r["page_id"]] = (r["url"], text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in llm.QUERIES["op2_page_text"](spark, SF).collect()}
    assert got == want


def test_page_query(spark):
    for r, text in ((r, r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()):
        article = re.search(r"<article>(.*)</article>", text, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert "\n".join(b for b in blocks if b) == "\n".join(t for role, t in page_blocks(text) if role == 2), r["page_id"]


# --- personal data in other forms

def test_proposals_are_bounded_by_digits_alone():
    text = "call 00 33 6 12 34 56 78 now"
    assert ("00 33 6 12 34 56 78", "phone") in {(text[a:b], k) for a, b, k in candidates(text)}
    long = "1 " * 400
    found = candidates(long)
    assert found and max(sum(c.isdigit() for c in long[a:b]) for a, b, _ in found) == 19


def test_veiled_forms_are_found(spark):
    """Veiled addresses and numbers of unseen texts are accepted though no such form is labelled; other numbers are not."""
    draw = random.Random(5)

    def number():
        return " ".join("".join(str(draw.randrange(10)) for _ in range(n)) for n in (3, 3, 4))

    def text(i, veil):
        name = f"{draw.choice(['ann', 'bob', 'cyd'])}{i}"
        mail = f"{name}[at]site{i % 7}[dot]org" if veil else f"{name}@site{i % 7}.org"
        call = f"(212) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}" if veil else f"+1 {number()}"
        return (f"order {draw.randrange(10 ** 8, 10 ** 9)} of 2024-0{1 + i % 9}-1{i % 10} please write mail to {mail} or call phone {call} today. "
                f"parts {draw.randrange(100, 999)} {draw.randrange(1000, 9999)} {draw.randrange(10)} were sent"), mail, call

    seen = [(i, text(i, i % 10 == 0)[0]) for i in range(400)]
    judge = fit_judge(spark.createDataFrame(seen, "doc_id long, text string"))
    hits = wrong = 0
    for i in range(400, 500):
        whole, mail, call = text(i, True)
        base, every = judge.spans(whole)
        assert base == []
        found = {whole[a:b] for a, b, _ in every}
        hits += mail in found
        wrong += sum(not (w in mail or mail in w or w in call or call in w) for w in found)
    assert hits >= 90 and wrong <= 2, (hits, wrong)


def test_personal_data_query(spark):
    """Counts, digest and order of spans of the query equal those from plain patterns over all texts."""
    got = {r["doc_id"]: r for r in llm.QUERIES["op8_personal_data"](spark, SF).collect()}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15}[kind]

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for doc, text in rows:
        spans = sorted(((m.start(), KINDS.index(k), k, m.end()) for k, p in plain.items() for m in re.finditer(p, text or "") if right(k, m[0])))
        listed = [f"{k}:{a}:{b}" for a, _, k, b in spans]
        row = got[doc]
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(row["spans"].split(",") if row["spans"] else [])


# --- secrets

BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}
PIECES = ["token", "secret", "ToKeN", "=", ":", " ", '"', "'", "abc", "abcdefgh", "AKIA", "AKIAABCDEF012345", "é", "日",
          "0123456789abcdef0123456789abcdef", "ff", "api_key", "passwd", ".", "-", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_secrets_are_the_regular_expressions(text):
    want = sorted((m.start(), i, k, m.end()) for i, (k, (rule, long)) in enumerate(BASE.items()) for m in re.finditer(rule, text) if long(m))
    assert [s for s in scanner(RULES).spans(text) if s[0] in BASE] == [(k, a, b) for a, _, k, b in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12).map("".join), st.sampled_from(["a(b|c)*", "ab?c{2}", "(ab|ba)+c", "[ab]{2,3}c", "a{2,}b"]))
def test_automaton(text, rule):
    whole = compile_rules([rule], anywhere=False)
    found = re.match(rule, text)
    longest = max((n for n in range(1, len(text) + 1) if re.fullmatch(rule, text[:n])), default=-1)
    assert whole.longest(text.encode(), 0, len(text)) == longest and (found is None) == (longest == -1)


def test_minimal_automaton():
    assert compile_rules(["abc|abd|aec|aed"], anywhere=False).states == 5


def test_find_secrets(docs, no_docs):
    out = find_secrets(docs, mask=True, keep=["_id", "spans", "text"])
    assert out.count() == docs.count() and out.where("_id <> 'clash'").count() == 0
    assert out.where("masked_text <> coalesce(text, '') and text not like 'aaaa%'").count() == 0
    assert find_secrets(no_docs).count() == 0
    text = "é token = 'abcdefgh1' and 0123456789abcdef0123456789abcdef"
    assert masked(text, scanner(RULES).spans(text)) == "é [assign]' and [hex]"


# --- personal data

PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "25", "255", "300", "0001", " ", "-", "+", "(", ")", "4111111111111111",
                                 "+1 (555) 555-1234", "é", "%", "x@y.com", "10.0.0.1", "\n"]), max_size=12).map("".join))
def test_personal_base_spans(text):
    want = sorted((m.start(), KINDS.index(k), m.end()) for k, (rule, ok) in PERSONAL.items() for m in re.finditer(rule, text) if ok(m))
    assert [(a, KINDS.index(k), b) for a, b, k in base_spans(text)] == want


def test_personal_data(spark, docs, no_docs):
    draw = random.Random(3)
    def phone():
        return f"({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"
    rows = [(i, f"word {draw.randrange(99)} call +1 {phone()} or mail u{i}@m.example.com from 10.0.{i % 255}.7, nr {draw.randrange(10**9, 10**10)}") for i in range(400)]
    judge = fit_judge(spark.createDataFrame(rows, "doc_id long, text string"))
    assert judge.trees is not None
    base, spans = judge.spans("please call " + "(212) 555-0199 or mail jo[at]site[dot]org")
    assert base == [] and {"please call (212) 555-0199 or mail jo[at]site[dot]org"[a:b] for a, b, _ in spans} <= {"(212) 555-0199", "jo[at]site[dot]org"} and spans
    found = find_personal_data(docs, judge, mask=True)
    assert found.count() == docs.count() and found.where("size(base) > size(spans)").count() == 0
    assert find_personal_data(no_docs).count() == 0


def test_boosted_trees():
    draw = np.random.default_rng(1)
    x = draw.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    w = np.ones(1000)
    trees = BoostedTrees().fit(x[:1000], y[:1000], w).calibrate(x[1000:], y[1000:], w)
    assert ((trees.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95


# --- toxicity

def test_words_are_read_through_gaps():
    assert toxicity.word_set("i d i o t, st*upid; l0ser m.o.r.o.n Été") == {"idiot", "stupid", "loser", "moron", "ete"}
    assert toxicity.word_set("") == set()
    assert {"abcdefghijklmnopqrst", "klmnopqrstabcdefghij"} <= toxicity.word_set("abcdefghijklmnopqrst" * 3)


def test_kernel_is_the_sum_over_subsequences():
    def plain(a, b):
        def weights(w):
            out = Counter()
            for i, j, k in combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
            norm = sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in combinations(range(len(w)), 3) if k - i < toxicity.SPAN) ** 0.5
            return {s: v / norm for s, v in out.items()}
        x, y = weights(a), weights(b)
        return sum(v * y.get(s, 0) for s, v in x.items())
    words = ["idiot", "idxiot", "banana", "stupidity", "the"]
    k = toxicity.kernel_rows(words)
    assert np.allclose(k @ k.T, [[plain(a, b) for b in words] for a in words], atol=1e-5)


def test_toxicity_on_folds_it_has_not_seen(spark, docs, no_docs):
    draw = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    def word():
        return "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    insults = ["idiot", "stupid", "worthless"]
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[draw.randrange(60)] = draw.choice(insults)
        rows.append((i, ". ".join(" ".join(words[k:k + 10]) for k in range(0, 60, 10))))
        labels.append((i, int(bad)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(table, marks)
    unseen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, model).collect()}
    assert all((scores[i] >= 0.3) == (i % 4 == 0) for i in unseen)
    gapped = model.scores(["you are an i d i o t", "you are an idi*ot", "stuppid thing", "", "the heron ended"])
    assert (gapped[:3] >= 0.3).all() and (gapped[3:] < 0.3).all()
    kept = toxicity.score_toxicity(docs, model, keep=["text", "_id", "score"])
    assert kept.count() == docs.count()
    assert toxicity.score_toxicity(no_docs, None).count() == 0
    assert toxicity.fit_toxicity(table, marks.where("toxic = 0")) is None
    assert toxicity.fit_toxicity(table, marks.limit(0)) is None
    assert {r["score"] for r in toxicity.score_toxicity(table, None).collect()} == {0.0}


def test_toxic_stems_with_changing_endings(spark):
    draw = random.Random(6)
    syllables = ["der", "und", "ein", "sch", "ach", "lich", "keit", "ung", "ver", "be", "ge", "en", "er", "zu", "tz", "pf", "ie", "au"]
    def word(head=""):
        return head + "".join(draw.choice(syllables) for _ in range(draw.randrange(2, 4)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(60)]
        bad = i % 6 == 0
        for at in draw.sample(range(60), 3 if bad else int(i % 12 == 5)):  # clean texts hold the stem now and then
            words[at] = word("kromul")
        rows.append((i, ". ".join(" ".join(words[k:k + 10]) for k in range(0, 60, 10))))
        labels.append((i, int(bad)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    unseen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    flagged = {i for i, s in zip(unseen, model.scores([rows[i][1] for i in unseen])) if s >= 0.3}
    toxic = {i for i in unseen if i % 6 == 0}
    assert len(flagged & toxic) >= 0.9 * len(toxic) and len(flagged - toxic) <= 0.02 * len(unseen)


def test_stems_explain_words_once():
    odds = toxicity.toxic_stems(pd.DataFrame(
        [("abcde", "xabcde", 60, 0), ("bcdef", "xbcdef", 0, 30), ("abcde", "abcdef", 60, 0), ("bcdef", "abcdef", 60, 0)],
        columns=["stem", "word", "toxic", "clean"]), 0.1)
    assert list(odds) == ["abcde"]
    found = toxicity.Stems({"abcde": 2.0, "^bcdef": 3.0, "^abcd": 1.0}).odds(toxicity.words_of(["xabcde abcdef bcdefg abcd x", "nothing", ""]))
    assert found.tolist() == [2.0, 2.0, 3.0, 1.0, 0.0, 0.0]
    assert toxicity.Stems({}).odds(toxicity.words_of([""])).tolist() == []


# --- near copies

def plain_join(rows, threshold=0.8):
    word = re.compile(r"(?:[a-z0-9_]|[^\x00-\x7f])+")
    sets = []
    for doc_id, text in rows:
        w = word.findall((text or "").lower())
        sets.append((doc_id, frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w and doc_id is not None else frozenset()))
    links, root = Counter(), {d: d for d, _ in sets}
    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return Counter((d, find(d), links[d]) for d, _ in sets)


def near_rows(n=60):
    draw = random.Random(9)
    rows = []
    for g in range(n):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([3, 40, 150]))]
        for _ in range(draw.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(draw.choice([0, 1, 2, 3])):
                words[draw.randrange(len(words))] = "x" + str(draw.randrange(9))
            rows.append((len(rows) + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 2, "block_shingles": 200}])
def test_jaccard_join(spark, limits):
    rows = near_rows()
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == plain_join(rows)


def test_jaccard_join_of_awkward_rows(docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join(docs).collect())
    want = plain_join([r for r in rows if r[0] is not None]) + Counter([(None, None, 0)])
    # a row that is there twice is two copies of one another
    assert {k[:2] for k in got} == {k[:2] for k in want} and sum(got.values()) == len(rows)
    assert jaccard_join(no_docs).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches(0.8, 1e-6)
    assert len(least) == 8 and least == sorted(least) and least[-1] < 0.8 * 128
    draw = np.random.default_rng(2)
    lost = 0
    for _ in range(300):
        common, own = draw.integers(0, 1 << 62, 160, dtype=np.uint64), draw.integers(0, 1 << 62, (2, 20), dtype=np.uint64)
        a, b = ((minimum_hashes(np.concatenate([common, o])) & 0xFF).astype(np.uint8) for o in own)
        lost += len(near_dup.similar(a, b[None], least)) == 0
    assert lost == 0
    far = (minimum_hashes(draw.integers(0, 1 << 62, 200, dtype=np.uint64)) & 0xFF).astype(np.uint8)
    assert len(near_dup.similar(a, far[None], least)) == 0


def test_words_of_all_scripts():
    """Typographic marks part words, and one changed character of a text without spaces leaves it similar."""
    assert shingles("\u201cone two\u201d \u2013 three\u00a0four five\u2026 six").tolist() == shingles('"one two" - three four five... six').tolist()
    assert shingles("na\u00efve caf\u00e9 a b c").tolist() == shingles("NA\u00cfVE, caf\u00e9: a b c").tolist() and len(shingles("na\u00efve caf\u00e9 a b c")) == 1
    one = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(300))
    other = one[:150] + "\u4e8c" + one[151:]
    a, b = set(shingles(one).tolist()), set(shingles(other).tolist())
    assert len(a) == 296 and len(a & b) / len(a | b) > 0.9
    for text in ("", "\u3002", "a\u4e00b", "\U00020000x", "\u0939\u093f\u0928\u094d\u0926\u0940 x"):
        want = re.findall("[\u4e00\U00020000]|[\u0939\u093f\u0928\u094d\u0926\u0940a-z]+", text)
        raw, starts, ends = word_bounds(text)
        assert [text[i:j] for i, j in zip(starts, ends)] == want


def test_near_copies_without_spaces(spark):
    one = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(300))
    quoted = " ".join(f"word{i}" + (",\u201d" if i % 9 == 0 else "") for i in range(60))
    rows = [(1, one), (2, one[:150] + "\u4e8c" + one[151:]), (3, one[::-1]), (4, quoted), (5, quoted.replace("\u201d", '"')), (6, quoted[::-1])]
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[4] == got[5] and len(set(got.values())) == 4


def test_shingles():
    assert len(shingles("")) == 0 and len(shingles("... !")) == 0 and len(shingles("a b c")) == 1
    assert shingles("A b, c d e f").tolist() == shingles("a b c d  e F.").tolist() and len(shingles("a b c d e f")) == 2
    assert set(shingles("z a b c d e")) & set(shingles("a b c d e")) == set(shingles("a b c d e"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    joined = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in root.items() if n in joined}


# --- search

def test_impact_index_proves_its_stop():
    draw = np.random.default_rng(4)
    vectors = draw.integers(-300, 300, (500, 24))
    index = ImpactIndex(vectors)
    for q in vectors[:40]:
        members, scores = index.search(q, 10, np.array([], int))
        best = sorted((-(vectors @ q)).tolist())[:10]
        assert sorted((-scores).tolist())[:10] == best and len(members) < 500


def test_top_k(spark):
    draw = random.Random(8)
    rows = [(i, [draw.randrange(-9, 9) for _ in range(4)], "x") for i in range(60)]
    rows += [(60, rows[3][1], "x"), (61, rows[3][1], "x"), (62, None, "x"), (63, [1, None, 2, 3], "x"), (64, [1, 2], "x"), (None, [1, 2, 3, 4], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>, score string")
    got = top_k(vectors, vectors.where("vec_id % 10 = 0"), k=7, block_rows=9, block_queries=2).collect()
    usable = [(i, v) for i, v, _ in rows if i is not None and v and None not in v]
    want = set()
    for i, q in usable:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:7]
            want |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# --- queries and the pipeline

def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(str, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    got = llm.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in llm.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert plain(got) == plain(con.execute(llm.ORACLE[name]).fetchdf())
    elif name.split("_")[0] not in ("op2", "op9", "op12", "op13"):
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(2).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text", "n_chars").collect()]
        docs = llm.common.staged(stage(spark, docs, SF), name)
        after = [tuple(r) for r in docs.select("doc_id", "text", "n_chars").collect()]
        assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.8 * len(before)
        elif name == "exact_dedup":
            norm = defaultdict(list)
            for d, t, _ in before:
                norm[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, -1 if d is None else d))
            want = {min(g)[2] for g in norm.values()}
            assert Counter(-1 if d is None else d for d, _, _ in after) == Counter(want)
        elif name == "jaccard_join":
            known = {(d, c) for d, c, _ in plain_join([(d, t) for d, t, _ in before if d is not None])}
            assert {d for d, _, _ in after if d is not None} == {d for d, c in known if d == c}
        else:
            old = {d: t for d, t, _ in before}
            for d, t, n in after:
                assert t == (None if old[d] is None else masked(old[d], scanner(RULES).spans(old[d]))) and (t is None or n == len(t))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048 or bit_count(n) <> 1")
    assert sizes.count() == 0


def test_digests(spark):
    """The digest columns of the two span queries from the spans."""
    got = {r["doc_id"]: r for r in llm.QUERIES["op4_secret_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        spans = sorted((m.start(), i, k, m.end()) for i, (k, (rule, long)) in enumerate(BASE.items()) for m in re.finditer(rule, text) if long(m))
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in spans) for k in BASE]
