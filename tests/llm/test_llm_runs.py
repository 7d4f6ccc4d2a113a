"""Periodic runs, whitening and URL rules against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsgauge.llm.periodic_runs import Grammar, digests, find_runs, kept_words, op11_periodic_runs, runs_of, with_planted_periods
from newsgauge.llm.url_rules import RULES, judge_urls, match_rules, mine_rules, op13_url_rules, stated_rule, url_host, url_path, url_tokens
from newsgauge.llm.whitening import fit_whitening, identity_error, op12_whitening, usable_vectors, whiten

SF = "/root/testdata/sf0.001"


# --- periodic runs ---------------------------------------------------------------------------------

def brute_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_kept(n, runs):
    return [not any(s + q <= i < s + length for s, length, q in runs) for i in range(n)]


words_in_runs = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=6).map(
    lambda parts: [w for part, times in parts for w in part * times])


@settings(max_examples=200, deadline=None)
@given(st.lists(words_in_runs, min_size=1, max_size=4))
def test_runs_of(documents):
    """Documents of one call share a grammar and do not reach into each other."""
    got = runs_of([np.array(d, np.int64) for d in documents])
    for words, runs in zip(documents, got):
        expected = brute_runs(words)
        assert [tuple(r) for r in runs.tolist()] == expected
        assert kept_words(len(words), runs).tolist() == brute_kept(len(words), expected)


@settings(max_examples=60, deadline=None)
@given(words_in_runs.filter(lambda w: len(w) > 2), st.data())
def test_extensions(words, data):
    s = np.array([100, *words, 101])
    grammar = Grammar(s)
    pairs = data.draw(st.lists(st.tuples(st.integers(1, len(words)), st.integers(1, len(words))).filter(lambda p: p[0] < p[1]), min_size=1))
    for step in (1, -1):
        got = grammar.extend(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), step)
        for (a, b), n in zip(pairs, got):
            same = 0
            while s[a + step * same] == s[b + step * same]:
                same += 1
            assert same == n


def test_grammar_is_small_for_repeats():
    """Repeats of a long text are named once a level."""
    grammar = Grammar(np.concatenate([[10**6], np.tile(np.arange(1000), 200), [10**6 + 1]]))
    assert grammar.names - (10**6 + 2) < 20_000
    found = runs_of([np.tile(np.arange(1000), 200)])[0].tolist()
    assert found == [[0, 200_000, 1000]]


def test_shortest_run():
    with pytest.raises(ValueError):
        runs_of([np.zeros(20, np.int64)], least=8)
    assert [len(r) for r in runs_of([np.zeros(11, np.int64), np.zeros(12, np.int64), np.zeros(0, np.int64)])] == [0, 1, 0]


def expected_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for w, k in zip(words, brute_kept(n, runs)) if k)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query(spark):
    """The query's rows over a whole table of short texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r["text"] or "") < 6000]
    assert len(short) > 150
    assert all(got[r["doc_id"]] == expected_digest(*r) for r in short)


def test_runs_awkward(spark, docs, no_docs):
    """Null, blank, repeated and foreign texts; ids without a value; clashing columns."""
    loops = spark.createDataFrame([(i, "x " * 13 + "\u00a0 b\x1cc " * 7) for i in range(40, 80)], "doc_id long, text string")
    table_ = docs.where("length(text) < 20000 or text is null").select("doc_id", "text").unionByName(loops)
    got = digests(find_runs(with_planted_periods(table_)))
    assert Counter(map(tuple, got.collect())) == Counter(expected_digest(r["doc_id"], r["text"]) for r in table_.collect())
    out = find_runs(docs, keep=["text", "spans", "_keep0"], slice_bytes=1000)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed_text", "text", "spans", "_keep0"]
    assert out.count() == docs.count() and out.where("spans <> 'clash' or _keep0 <> 'clash'").count() == 0
    assert out.where("size(runs) = 0 and n_words > 0 and collapsed_text <> array_join(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), ' ')").count() == 0
    assert find_runs(no_docs).count() == 0


def test_long_text_of_one_word(spark):
    row = find_runs(spark.createDataFrame([(1, "so " * 100_000)], "doc_id long, text string")).first()
    assert row["runs"] == [(0, 100_000, 1)] and row["collapsed_text"] == "so"


# --- whitening -------------------------------------------------------------------------------------

def plain_whitening(x, k=8):
    x = np.asarray(x, float)
    away = x - x.mean(axis=0)
    _, sizes, v = np.linalg.svd(away)  # the covariance itself has lost the small ones to rounding
    e = sizes**2 / len(x)
    return away @ v[:k].T / np.sqrt(e[:k]), e


def fitted(spark, x):
    rows = usable_vectors(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>"), F.col("v"))
    model = fit_whitening(rows)
    return model, {r["vec_id"]: r for r in whiten(rows, model).collect()}, identity_error(rows, model)


@pytest.mark.parametrize("shape", ["flat", "decaying", "low rank", "equal values"])
def test_whitening(spark, shape):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 20))
    if shape == "decaying":
        x = x @ np.linalg.qr(draw.normal(size=(20, 20)))[0] * 2.0 ** -np.arange(20)
    if shape == "low rank":
        x = draw.normal(size=(300, 5)) @ draw.normal(size=(5, 20))
    if shape == "equal values":
        x = np.vstack([np.eye(20), -np.eye(20)])  # all variances are one
    x = np.floor(x * 4096) + 100000
    model, got, error = fitted(spark, x)
    rank = {"low rank": 5}.get(shape, 8)
    z = np.array([got[i]["whitened"] for i in range(len(x))])
    plain, e = plain_whitening(x, rank)
    # rounding to whole numbers gives the low-rank rows a little variance in all directions
    assert z.shape == (len(x), 8) and error < 1e-6
    assert np.allclose(model.variances, e[:8], rtol=1e-9) and math.isclose(model.total, e.sum(), rel_tol=1e-9)
    if shape in ("flat", "decaying", "low rank"):
        assert np.abs(z[:, :rank] * np.sign((z[:, :rank] * plain).sum(axis=0)) - plain).max() < 1e-7
    n, sums = len(x), [int(c) for c in x.sum(axis=0)]
    assert [got[i]["deviation"] for i in range(n)] == [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums)) for v in x]


def test_whitening_stops_early(spark):
    """Where few directions hold nearly all variance, far fewer steps than dimensions do."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 60)) * 2.0 ** -np.minimum(np.arange(60), 16)
    x = np.floor(x * 2**30)
    model, got, error = fitted(spark, x)
    plain, e = plain_whitening(x)
    z = np.array([got[i]["whitened"] for i in range(len(x))])
    assert model.steps < 40 and error < 1e-6 and np.allclose(model.variances, e[:8], rtol=1e-12)
    assert np.abs(z * np.sign((z * plain).sum(axis=0)) - plain).max() < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [], [nan, 1.0], [1.0, inf], [None, 1.0], [3.0, 1.0], [3.0, 1.0], [1.0, 2.0, 3.0], [2.0**60, 0.0], [0.0, 5.0]]
    df = spark.createDataFrame([(i if i != 6 else None, v, "clash", "clash") for i, v in enumerate(vectors)], "vec_id long, v array<double>, x string, place string")
    rows = usable_vectors(df, F.col("v"))
    assert Counter(r[0] for r in rows.collect()) == Counter([0, None, 7, 10])
    model = fit_whitening(rows)
    assert model.rows == 4 and model.sums == [7, 9] and len(model.variances) == 2
    assert {r["deviation"] for r in whiten(rows, model).collect()} == {(4 * a - 7) ** 2 + (4 * b - 9) ** 2 for a, b in ((1, 2), (3, 1), (0, 5))}
    for few in ([], [[4.0, 4.0]], [[4.0, 4.0]] * 3):
        model, got, error = fitted(spark, few) if few else (None, {}, 0.0)
        assert error == 0.0 and all(r["whitened"] == [] and r["deviation"] == 0 for r in got.values())
    assert fit_whitening(rows.limit(0)) is None and whiten(rows, None).count() == 0 and identity_error(rows, None) == 0.0


def test_deviation_beyond_64_bits(spark):
    model, got, _ = fitted(spark, [[0.0], [2.0**40], [2.0**40], [-(2.0**34)]])
    n, x = 4, [0, 2**40, 2**40, -(2**34)]
    exact = [(n * c - sum(x)) ** 2 for c in x]
    assert [got[i]["deviation"] for i in range(4)] == [v if v < 2**63 else None for v in exact] and None in [got[i]["deviation"] for i in range(4)]


def test_whitening_query(spark):
    raw = [(r[0], np.floor(np.array(r[1], float) * 1024) + 100000) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    plain, e = plain_whitening([v for _, v in raw])
    rows = op12_whitening(spark, SF).collect()
    assert len(rows) == 8 * len(raw) and {r["n"] for r in rows} == {len(raw)} and {r["identity_error"] for r in rows}.pop() < 1e-9
    place = {v: i for i, (v, _) in enumerate(raw)}
    z = np.zeros((len(raw), 8))
    for r in rows:
        z[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9)
    assert np.abs(z * np.sign((z * plain).sum(axis=0)) - plain).max() < 1e-8


# --- URL rules -------------------------------------------------------------------------------------

URLS = ["https://EXAMPLE.org/es/1", "http://a.example.org/en/12?x=1", "http://a.example.org/en/2#t", "https://badexample.org/en/12", "ftp://x.com/fr/?a", "//x.com/fr/",
        "x.com/de/", "http://com/de/1", "http://xcom/de/1", "http://m.com/DE/1", "a://b://c/d", "", None, "http://", "http://org", "http://org/", "http://x.org?y=/es/",
        "http://Ä.ORG/ß", "see http://x.com\n/de/ http://y", "HTTP://u.example.COM/de/?utm=1&ref=2&utm=3", "http://s.t.u.v.w.example.net/1/2/3/4/5/6/a.html",
        "http://shop.example.net/buy/now?cart=1"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(url, rules=RULES):
    host, path = brute_parts(url)
    fits = [(len(rule), verdict, rule) for verdict, rule in rules
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_stated_rules(apply):
    got = apply(lambda u: F.struct(url_host(u), url_path(u), stated_rule(url_host(u), url_path(u))["verdict"], stated_rule(url_host(u), url_path(u))["rule"]), URLS)
    assert [tuple(r) for r in got] == [brute_parts(u) + brute_rule(u) for u in URLS]


def test_tokens(apply):
    got = apply(url_tokens, URLS)
    assert all(len(t) <= 15 and len(set(t)) == len(t) for t in got)
    assert set(got[1]) == {"scheme:http", "top:org", "tail:example.org", "query:x", "sub:a", "path:0:en", "num:2:1"}
    assert set(got[-3]) == {"scheme:http", "top:com", "tail:example.com", "query:ref&utm", "sub:u", "path:0:de", "end:/"}
    assert got[12] == [] and got[11] == []


def brute_mined(rows, min_support, min_confidence, min_lift, longest):
    rows = [(frozenset(t), v) for t, v in rows if t and v in ("allow", "block")]
    n = len(rows)
    every, by_verdict = Counter(), Counter()
    for tokens, verdict in rows:
        for k in range(1, longest + 1):
            for part in itertools.combinations(sorted(tokens), k):
                every[part] += 1
                by_verdict[part, verdict] += 1
    share = Counter(v for _, v in rows)
    rules = {(t, v): c / every[t] for (t, v), c in by_verdict.items()
             if c >= math.ceil(min_support * n) and c / every[t] >= min_confidence and c / every[t] / (share[v] / n) >= min_lift}
    return {key: conf for key, conf in rules.items()
            if not any((part, key[1]) in rules and rules[part, key[1]] >= conf for k in range(1, len(key[0])) for part in itertools.combinations(key[0], k))}


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(2)
    rows = []
    for _ in range(400):
        tokens = {draw.choice("ab"), draw.choice("cdef"), *draw.sample("ghijk", draw.randrange(3))}
        block = ("c" in tokens and "a" in tokens) or draw.random() < 0.1
        rows.append((sorted(tokens), "block" if block else "allow"))
    return rows + [([], "block"), (["a", "c"], None), (["a"], "other")]


def test_mining(spark, labelled):
    options = {"min_support": 0.02, "min_confidence": 0.7, "min_lift": 1.05, "longest": 3}
    rules = mine_rules(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), **options).orderBy("rank").collect()
    expected = brute_mined(labelled, **options)
    assert (("a", "c"), "block") in expected and len(expected) > 3
    assert {(tuple(r["tokens"]), r["verdict"]): pytest.approx(r["confidence"]) for r in rules} == expected
    order = [(-r["confidence"], -r["support"], len(r["tokens"]), " ".join(r["tokens"]), r["verdict"]) for r in rules]
    assert order == sorted(order)


@pytest.mark.parametrize("at_once", [100_000, 2])
def test_matching(spark, labelled, at_once):
    """More rules than a worker holds at once give the same verdicts."""
    rules = mine_rules(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), min_support=0.02, min_confidence=0.7)
    listed = [(r["rank"], set(r["tokens"]), r["verdict"]) for r in rules.orderBy("rank").collect()]
    sets = [sorted(x) for k in range(5) for x in itertools.combinations("abcdefgz", k)] + [None]
    got = match_rules(spark.createDataFrame(list(enumerate(sets)), "i int, tokens array<string>"), rules, at_once=at_once)
    for r in got.collect():
        expected = next(((rank, verdict) for rank, tokens, verdict in listed if tokens <= set(r["tokens"] or ())), (None, None))
        assert (r["mined_rank"], r["mined_verdict"]) == expected


def test_url_query(spark):
    """Hosts, paths and stated rules of the whole table; all other rows are judged by the mined rules, which learn from the stated."""
    urls = dict(map(tuple, spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()))
    rows = op13_url_rules(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        verdict, rule = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (*brute_parts(urls[r["page_id"]]), rule)
        assert r["verdict"] == verdict if rule else r["by"] in ("mined", "default") and r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in rows if r["by"] == "mined"} == {"allow", "block"}


def test_urls_awkward(spark):
    rows = [(i % 4 if i else None, u, "clash", "clash", "clash") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, tokens string, _keep0 string")
    out = judge_urls(pages, keep=["url", "tokens", "_keep0"], min_support=0.05)
    assert out.count() == len(rows) and out.where("tokens <> 'clash' or _keep0 <> 'clash' or verdict is null").count() == 0
    assert all((r["host"], r["path"], r["rule"]) == (*brute_parts(r["url"]), brute_rule(r["url"])[1]) for r in out.collect())
    assert judge_urls(pages.limit(0)).count() == 0
    nothing = judge_urls(pages, rules=(), default="block").collect()
    assert {(r["verdict"], r["by"], r["rule"]) for r in nothing} == {("block", "default", None)}


def test_held_out_urls(spark):
    """Rules mined from three quarters of labelled addresses tell the rest."""
    draw = random.Random(5)
    urls = []
    for i in range(1200):
        bad = i % 3 == 0
        host = draw.choice(["casino", "bets", "track"] if bad else ["news", "blog", "docs"])
        urls.append((i, f"http://{host}{'' if draw.random() < .9 else 'x'}.example.net/{draw.choice(['en', 'de'])}/{i}", "block" if bad else "allow"))
    df = spark.createDataFrame(urls, "page_id long, url string, verdict string")
    out = judge_urls(df.where("page_id % 4 = 0"), rules=(), labelled=df.where("page_id % 4 <> 0")).collect()
    truth = {i: v for i, _, v in urls}
    assert sum(r["verdict"] == truth[r["page_id"]] for r in out) / len(out) > 0.95
