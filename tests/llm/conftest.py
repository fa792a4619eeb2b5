"""Awkward documents: nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    long = prose(20_000, 1)
    base = prose(120, 2)
    return [
        (1, base, "en", "a", 1), (2, base, None, "a", None), (3, base + " tail end", "en", None, 3), (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, " \t\n ", "en", "b", 4), (7, long, "en", "a", 9), (7, long, "en", "a", 9),
        (8, "one", "en", "a", 3), (9, "ONE", "en", "c", 3), (None, base, "en", "c", 2), (None, None, None, None, None), (10, prose(60, 3) + "\n" + prose(60, 4), "en", "c", 1), (11, "other words here\n" + prose(60, 4), "en", "a", 1), (12, "é ü 漢字 " + prose(30, 5), "fr", "a", 7),
        (13, "x" * 5000, "en", "a", 5000),
    ]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("size", "taken", "key", "fp", "score", "bucket", "_key", "w", "h", "words", "component_id", "node", "a", "b", "unit", "block", "term", "email", "start", "text_key", "held_out", "_d", "_t", "_s", "_b", "_l", "_n", "_size", "_cut", "_weight", "s", "n", "lead", "pairs", "told")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def tokenizer_file():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def sample_data() -> str:
    if not os.path.exists(DATA):
        pytest.skip("no sample data")
    return DATA
