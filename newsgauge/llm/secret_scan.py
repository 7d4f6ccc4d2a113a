"""Secrets: all rules in one minimised automaton, scanned in one pass over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.automaton import Automaton, compile_rules
from newsgauge.llm.common import carried, given_back, in_slices, query, table, text_of


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` then ``body``; it counts if the whole and the body are long enough.

    A match that is too short is passed over as a whole, as in a left-to-right search. Lengths are
    checked after the scan, so that counting does not multiply the states.
    """

    kind: str
    head: str
    body: str
    least: int = 0
    least_body: int = 0
    base: bool = False


# The kinds of secrets and their formats.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?",
         r"[A-Za-z0-9+/_.=\-]+", least_body=8, base=True),
    Rule("access", "AKIA", "[A-Z0-9]+", least=16, base=True),
    Rule("hex", "", "[0-9a-f]{6,}", least=32, base=True),
    Rule("private_key", "-----BEGIN ", "(RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9\\-]+", least=15),
    Rule("google", "AIza", "[A-Za-z0-9_\\-]+", least=39),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]+", least=24),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_.\-]+", least=40),
)

Span = tuple[str, int, int]


class Scanner:
    """The rules compiled: one automaton that finds where matches end, and small ones to place them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        whole = [r.head + r.body for r in rules]
        self.search = compile_rules(whole, anywhere=True)
        self.forward = [compile_rules([w], anywhere=False) for w in whole]
        self.backward = [compile_rules([w], anywhere=False, backwards=True) for w in whole]
        self.heads = [compile_rules([r.head], anywhere=False) if r.head else None for r in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of all matches that count, in bytes.

        The pass steps through all bytes once. At the first end of a new match of a rule, the match is
        placed: backwards to its leftmost start after the rule's previous match, then forwards to its
        longest end.
        """
        found = []
        search: Automaton = self.search
        moves, accepting, rules_of = search.moves, search.accepting, search.rules
        past = [0] * len(self.rules)
        s = search.start
        for i, c in enumerate(data.translate(search.classes)):
            s = moves[s + c]
            if s >= accepting:
                for k in rules_of[s]:
                    if i < past[k]:
                        continue
                    start = self.backward[k].longest(data, i, past[k] - 1, -1) + 1
                    if start == 0 and (past[k] > 0 or self.backward[k].longest(data, i, -1, -1) != -1):
                        continue
                    end = self.forward[k].longest(data, start, len(data))
                    past[k] = end
                    rule = self.rules[k]
                    body = self.heads[k].longest(data, start, end) if rule.least_body else start
                    if end - start >= rule.least and end - body >= rule.least_body:
                        found.append((k, start, end))
        return found

    def spans(self, text: str) -> list[Span]:
        """(kind, start, end) in code points, by start and then in the order of the rules."""
        data = text.encode()
        found = self.byte_spans(data)
        place = {}
        if found and len(data) != len(text):
            at = points = 0
            for cut in sorted({x for _, a, b in found for x in (a, b)}):
                points += len(data[at:cut].decode())
                place[cut] = points
                at = cut
        found = [(place.get(a, a), k, place.get(b, b)) for k, a, b in found]
        return [(self.rules[k].kind, a, b) for a, k, b in sorted(found)]


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once, on the driver; the tasks get the finished tables."""
    return Scanner(rules)


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 mask: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The secrets in each text: doc_id, the columns ``keep`` and spans (kind, start, end in code points, end exclusive).

    Matches are leftmost and do not overlap within a kind; those of different kinds may. With ``mask``
    a column masked_text holds the text with its secrets replaced. One row per row of ``docs``, whatever
    its other columns are called; a null or empty text has no spans. Each row is scanned for itself, so
    nothing is shuffled and no key can be hot.
    """
    given = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *carried(keep))
    find = scanner(rules).spans

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column("_text").to_pylist()
            spans = [find(t) for t in texts]
            names = [n for n in batch.schema.names if n != "_text"]
            cols = [*(batch.column(n) for n in names),
                    pa.array([[dict(zip(("kind", "start", "end"), x)) for x in s] for s in spans], SPANS)]
            if mask:
                cols.append(pa.array([masked(t, s) for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "_spans", "_masked"][: len(cols)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    out = f"{kinds}, _spans array<struct<kind: string, start: bigint, end: bigint>>"
    found = given.mapInArrow(scan, out + (", _masked string" if mask else ""))
    return found.select(F.col("_id").alias("doc_id"), *given_back(keep), F.col("_spans").alias("spans"),
                        *([F.col("_masked").alias("masked_text")] if mask else []))


def joined(spans, *kinds: str):
    """Spans as kind:start:end, joined by commas; only of ``kinds`` if some are given."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    return found.select(
        "doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.col("spans"), *base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
