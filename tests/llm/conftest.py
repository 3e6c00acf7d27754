from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(("the", "of", "and", "wanor", "stil", "breth", "oun", "tig", "elm", "varo")) + r.choice(("", "a", "en", "is")) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null and empty texts, white space only, one word, repeats, a very long text, unusual characters."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    one = prose(1, 120)
    return [
        (1, one), (1, one), (2, one), (3, None), (4, ""), (5, " \t\n "), (6, "word"), (7, "two words"),
        (None, one), (None, None), (8, long), (9, long + " more"), (10, "日本語 ▁ 😀 \x00 é x"), (11, "x" * 50_000),
        (12, prose(2, 300)), (13, "a\n\nb\n\n\nc.. d!"), (14, "the " * 400),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names clash with those of the operators."""
    names = "score string, predicted string, n_words string, kept string, n_tokens string, batch string, bucket string, root string"
    rows = [(i, t, *(["x"] * 8)) for i, t in odd_rows]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, score string")
