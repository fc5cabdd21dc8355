"""Small tables for the operators' tests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "river stone glass market garden winter summer bridge letter window paper silver copper forest island harbour valley engine mirror candle".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with those the operators add."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (7, "one"), (8, "one two"), (9, sentence(rng, 30_000)),
        (10, sentence(rng, 60) + " " + base), (11, "Straße naïve 漢字 \U0001f600 é"), (12, "x" * 5000), (None, base), (None, None), (13, "said the \"word\""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("bucket", "hashes", "node", "label", "score", "group", "length", "key", "ids", "is_count", "cluster", "mark", "b", "guest", "toxic")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
