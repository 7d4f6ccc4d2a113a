import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _hash string, _norm string, _id string, _text string, "
          "ids string, spans string, node string, part string, score string, _keep0 string, start string")


def awkward(texts, first=1):
    """Rows of a documents table with extra columns whose names the operators use themselves."""
    extra = ["clash"] * 11
    return [(i, t, "en", "src0", len(t) if t is not None else None, *extra) for i, t in enumerate(texts, first)]


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, very long, equal, near-equal and non-Latin texts."""
    draw = random.Random(11)
    words = ["the", "of", "stone", "River", "über", "naïve", "日本", "a", "and", "ing", "tion", "x1", "don't", "end."]
    long = " ".join(draw.choice(words) + str(draw.randrange(50)) for _ in range(30_000))
    base = [draw.choice(words) + str(draw.randrange(30)) for _ in range(120)]
    near = [" ".join(base), " ".join(base[:60] + ["CHANGED"] + base[61:]), " ".join(base[:118])]
    return [None, "", " \n\t", "one", "one", "o n e", "two  words\n here", *near, near[0], long, "a" * 50_000, "日本 語 ﬁ ①",
            "▁mark ▁ <|endoftext|> </w>", "line\x1cfeed\x85 nbsp\xa0x"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The awkward texts, one row twice and one row without an id, over several partitions."""
    rows = awkward(texts)
    rows += [rows[6], (None, "no id at all but some words", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
