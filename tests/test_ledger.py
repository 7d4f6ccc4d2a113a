import random
from collections import Counter

import pytest

from newsgauge import values as v
from newsgauge.streaming.ledger import FACTS, Ledger, count_facts, keep_ledger


def counted(df):
    return {tuple(r)[:3]: r["n"] for r in df.select("keyword", "dimension", "key", "n").collect()}


def by_hand(facts):
    """Counts over the newest version of each payload."""
    last = {}
    for f in facts:
        last[f[0]] = max(last.get(f[0], ""), f[1])
    rows = [f for f in facts if f[1] == last[f[0]] and f[3] is not None]
    out, seen = Counter(), set()
    for payload, _, keyword, link, order, reason, source in sorted(rows, key=lambda f: (f[4], f[0])):
        if reason:
            out[keyword, "outcome", reason] += 1
        elif (keyword, link) in seen:
            out[keyword, "outcome", v.REASON_DUPLICATE] += 1
        else:
            seen.add((keyword, link))
            out[keyword, "outcome", "kept"] += 1
            out[keyword, "source", source] += 1
    return dict(out)


def payload(rng, name, version, n):
    rows = [(name, version, rng.choice("ab"), f"l{rng.randrange(6)}", f"{rng.randrange(1000):04d}{name}{i}", rng.choice([None, None, None, "noise"]), rng.choice(["news", "wechat"]))
            for i in range(n)]
    return rows or [(name, version, None, None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_increments_add_up_to_the_batch(spark, tmp_path, seed):
    """Late first rows, newer and older versions, payloads that lose all articles, batches that are replayed."""
    rng = random.Random(seed)
    ledger, landed = Ledger(spark, str(tmp_path), 4), []
    for batch in range(4):
        rows = [r for name in rng.sample("pqrst", 3) for r in payload(rng, name, str(rng.randrange(4)), rng.randrange(5))]
        # a version is landed once as it is: what was seen before comes as it was
        known = {(r[0], r[1]): [x for x in landed if x[:2] == r[:2]] for r in landed}
        fresh = [r for r in rows if (r[0], r[1]) not in known]
        again = [x for key in {r[:2] for r in rows if r[:2] in known} for x in known[key]]
        landed += fresh
        df = spark.createDataFrame(fresh + again, FACTS)
        for _ in range(2 if batch == 2 else 1):
            ledger.apply(df, batch)
        assert counted(ledger.counts()) == by_hand(landed)


def test_counts_of_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.counts().count() == 0
    ledger.apply(spark.createDataFrame([], FACTS), 0)
    assert ledger.counts().count() == 0 and count_facts(spark.createDataFrame([], FACTS)).count() == 0


def test_a_stream_keeps_a_ledger(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for name in "pq" for version in "12" for r in payload(rng, name, version, 4)]
    for i in (2, 1):
        spark.createDataFrame([r for r in rows if r[1] == str(i)], FACTS).coalesce(1).write.parquet(str(tmp_path / f"in/v{i}"))
    stream = spark.readStream.schema(FACTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "ledger"), 4)
    keep_ledger(stream, ledger, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert counted(ledger.counts()) == by_hand(rows)
