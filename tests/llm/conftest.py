"""Fixtures shared by the tests of the corpus operators."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TEXTS = [
    "Plain words that stand here and mean little at all today",
    "Plain words that stand here and mean little at all today",
    "",
    None,
    "!!! ### $$$",
    "Mail jo.doe@mail.example.com or +1 (555) 010-2233, host 10.0.0.255 and 300.1.1.1; card 4111 1111 1111 1111.",
    "ÄÖÜ straße École niño 漢字 text" + " word" * 5000,
    "x" * 30_000,
]


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture
def odd_docs(spark):
    """Awkward documents: nulls, empty and long texts, repeated rows, a null id, and columns with clashing names."""
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumns({c: F.lit("extra") for c in ("score", "key", "fp", "found", "n_words", "items", "rank", "source")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
