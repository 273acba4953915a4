from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, block int, n_words string"


def make_rows(seed: int = 5, n: int = 90) -> list[tuple]:
    """Words of a small vocabulary, copies, near copies, shared passages, and the odd rows every operator must take."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "é", "ÜBER", "The"]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage, base = words(70), words(120)
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(" ".join(words(rnd.randint(1, 160))))
        elif kind == 1:
            texts.append(" ".join(words(30) + passage + words(25)))
        elif kind == 2:
            near = list(base)
            for _ in range(rnd.randint(0, 5)):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            texts.append("\n".join(" ".join(near[k:k + 10]) for k in range(0, len(near), 10)))
        elif kind == 3:
            texts.append(" ".join(base))
        elif kind == 4:
            texts.append("\n".join([" ".join(words(9))] * rnd.randint(1, 12)))
        else:
            texts.append(" ".join(rnd.choice(("ab", "x")) for _ in range(rnd.randint(60, 260))))
    texts += [None, "", " \t\n", "one", "a" * 900, "日本語 😀 ▁ text\x0bmore\x85same", " ".join(words(3000)), "three short words", "THREE SHORT WORDS"]
    rows = [(i, text, ("en", "fr", None, "xx")[i % 4], (None, "b", "a", "hot", "hot")[i % 5], i, "r", i, "clash") for i, text in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[2], None, None, None, None, None, None), (7, "another text under a known id", "en", "a", 1, "", 0, "")]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def ready(spark):
    from flotilla.llm.tables import importable

    return importable(spark)


@pytest.fixture(scope="session")
def docs(ready, rows) -> DataFrame:
    return ready.createDataFrame(rows, SCHEMA).repartition(3, F.xxhash64("text", "doc_id"))


@pytest.fixture(scope="session")
def no_docs(ready) -> DataFrame:
    return ready.createDataFrame([], SCHEMA)
